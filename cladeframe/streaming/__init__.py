"""Counts kept up to date over streams of reads."""
