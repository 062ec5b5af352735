"""Query catalogue: adapters for the given tables, queries, their SQL, and whole studies."""
