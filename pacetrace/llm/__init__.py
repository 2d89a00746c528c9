"""Training-data operators: counting, encoding, packing, filtering, mixing and de-duplicating a text corpus."""
