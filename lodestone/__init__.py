"""Corpus and measurement analytics as PySpark DataFrame programs."""
