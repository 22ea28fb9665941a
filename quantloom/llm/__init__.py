"""Training-data operators: cleaning, deduplication, mixing and packing of text corpora."""
