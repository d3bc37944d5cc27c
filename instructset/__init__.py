"""Spark jobs that build, split, encode and score text-to-text datasets."""
