"""Genomic interval, signal and sequence analytics as Spark DataFrame plans."""
