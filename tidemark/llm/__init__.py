"""Training-data operators: packing, deduplication, scans, classifiers, search, tokenizing and extraction."""
