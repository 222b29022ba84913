"""Training-data operators: extraction, language, dedup, search, mixing, packing, output."""
