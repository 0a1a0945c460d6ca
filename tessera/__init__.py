"""A library for building and checking text corpora with DataFrames."""
