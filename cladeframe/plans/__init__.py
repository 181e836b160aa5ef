"""Queries assembled from the operators."""
