"""Training-data operators: sharding, tokenising, packing, search, mixing, dedup, scoring, filtering and scanning."""
