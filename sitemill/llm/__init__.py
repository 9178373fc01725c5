"""Training-data operators: deduplication, packing, filters, tokenization, search and formatting."""
