"""Operators for preparing training text: deduplication, filters, mixing and packing."""
