"""Training-data operators: dedup, scoring, packing, fingerprints, language, quality and mixing."""
