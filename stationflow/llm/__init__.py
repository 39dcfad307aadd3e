"""Training-data operators: search, scans, extraction, counting, packing, dedup, files."""
