"""DataFrame operators for documentation corpora and text tables."""
