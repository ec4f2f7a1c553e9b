"""Scalar functions as Spark columns: addresses, expressions, text, dates, hashes."""
