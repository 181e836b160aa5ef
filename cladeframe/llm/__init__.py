"""Operators that prepare text corpora for training. Nothing else in the package imports this one."""
