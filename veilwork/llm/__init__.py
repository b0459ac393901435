"""Training-data operators: deduplication, decontamination, filters, mixing and quality.

Nothing outside this subpackage imports it.
"""
