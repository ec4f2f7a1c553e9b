"""Colophon: cleaning, validating and measuring metadata records and text corpora on Spark."""
