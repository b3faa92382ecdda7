"""Training-data operators: quality, decontamination, packing, PII, near-duplicates, URL filters,
sharding, chat formatting, secret scans and nearest neighbours. Nothing else in the library imports this package."""
