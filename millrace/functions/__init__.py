"""Column functions: text normalisation, fingerprints, hashes, n-grams."""
