"""Readers of classifier output and ontologies, and writers of results."""
