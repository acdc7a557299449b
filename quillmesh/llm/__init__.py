"""Training-data operators: sharding, extraction, tokenizing, archives, fingerprints, deduplication, media, packing and filters."""
