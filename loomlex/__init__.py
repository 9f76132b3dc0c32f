"""Corpus analytics and text processing expressed as Spark DataFrame plans."""
