"""Training-data operators: recognition, cleaning, duplicates, packing, search."""
