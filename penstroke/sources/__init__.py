"""Readers: text corpora, conversation exports, profiles."""
