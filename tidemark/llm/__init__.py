"""Training-data operators: extraction, deduplication, tokens, quality, scoring, packing and sharding."""
