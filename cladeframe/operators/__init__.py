"""Grouped operators over trees, samples and sequences."""
