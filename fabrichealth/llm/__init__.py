"""Training-data operators: scoring, cleaning, deduplication, packing and output."""
