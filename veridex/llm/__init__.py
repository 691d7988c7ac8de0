"""Training-data operators: deduplication, scanning, tokenising, cleaning and scoring of document tables."""
