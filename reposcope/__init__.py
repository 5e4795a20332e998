"""Spark jobs over code corpora and architecture graphs, plus text operators."""
