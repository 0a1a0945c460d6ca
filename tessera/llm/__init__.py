"""Corpus operators for training data: one module per operator, each with its `query` and `ORACLE`."""
