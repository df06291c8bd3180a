"""Training-data operators: language models, quality, deduplication, encoding and packing."""
