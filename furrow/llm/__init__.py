"""Training-data operators: cleaning, deduplication, mixing and encoding."""
