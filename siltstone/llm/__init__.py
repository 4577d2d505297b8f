"""Operators for preparing training text: archives, filters, near copies, tokens, packing."""
