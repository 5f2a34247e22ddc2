"""Operators over whole tables: joins, aggregates, windows, sets, lineage, errors, quality, fidelity."""
