"""Training-data operators: mixing, language ID, chat formatting, URL filters, fingerprints, quality,
near-duplicates, sharding, byte-level BPE and embedding links. Nothing else in the library imports this package."""
