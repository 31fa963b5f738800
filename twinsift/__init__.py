"""Duplicate detection over tables of files, as Spark plans."""
