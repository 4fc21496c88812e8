"""Columnar scans with exact range-filter semantics, expressed as Spark plans."""
