"""Training-data operators: filters, near-duplicates, tokens, packing, scoring."""
