"""Comparative analytics over scored read counts and ontologies, as Spark DataFrame operations."""
