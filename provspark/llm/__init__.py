"""Training-data operators: filters, deduplication, tokenisation, scoring, packing."""
