"""Column functions: text, hosts, identifiers and regular-expression hits."""
