"""Penstroke: writing-style profiling and corpus preparation as Spark DataFrame operations."""
