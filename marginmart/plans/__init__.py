"""Plans: the registered query catalog, its DuckDB oracle, and report bundles."""
