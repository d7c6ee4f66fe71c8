"""Training-data operators: extraction, filtering, deduplication, packing and sharding of text corpora."""
