"""Profiles of texts that keep arriving."""
