"""Training-data operators: deduplication, filtering, tokenisation and packing of text corpora."""
