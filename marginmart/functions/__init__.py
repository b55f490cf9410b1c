"""Column-level functions: enrichment, metrics, labels."""
