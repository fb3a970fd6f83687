"""Operators for preparing training text: packing, mixing, language, search, filters, privacy, token files, duplicates, secrets."""
