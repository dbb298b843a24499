"""Operators: decoding, enrichment, rules, sequencing, state, aggregates, reconciliation."""
