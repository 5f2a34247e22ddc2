"""Column-level operators: projection, safe conversion, cleaning."""
