"""Corpus-preparation operators for large text collections (DataFrame in, DataFrame out)."""
