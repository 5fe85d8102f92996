"""Corpus preparation and vocabulary analytics as Spark DataFrame plans."""
