"""Mapping, reconciliation and data quality as Spark jobs."""
