"""Training-data operators: mixing, archives, filters, scans, near-duplicates, tokens, languages, quality."""
