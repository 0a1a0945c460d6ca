"""Sources of the corpus library."""
