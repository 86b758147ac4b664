"""Training-data operators: extraction, dedup, scoring, search, mixing and packing at corpus scale."""
