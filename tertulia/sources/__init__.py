"""Reading and writing corpora and result tables."""
