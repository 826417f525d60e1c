"""Training-data operators: dedup, scanning, scoring, tokenising and packing of text corpora."""
