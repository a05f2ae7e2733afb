"""DataFrame operators: families, key membership, row numbers, classification, summaries."""
