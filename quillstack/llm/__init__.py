"""Training-data operators: tokens, archives, personal data, quality, duplicates, search, packing."""
