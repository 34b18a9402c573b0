"""Operators for preparing training text: tokens, packing, filters, near duplicates, archives."""
