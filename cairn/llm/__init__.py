"""Training-data operators: extraction, filtering, deduplication, tokens and packing."""
