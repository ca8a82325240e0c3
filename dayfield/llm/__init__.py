"""Training-data operators: scanning, sharding, language, mixing, packing, search, filters, duplicates, quality."""
