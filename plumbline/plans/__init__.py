"""Whole mappings and event-log summaries, composed of the operators."""
