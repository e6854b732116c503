"""Training-data operators: tokenising, filtering, deduplication, scanning, scoring and packing of text."""
