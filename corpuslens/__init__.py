"""Provenance-preserving document analytics expressed as PySpark DataFrames."""
