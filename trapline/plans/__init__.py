"""Registered queries (catalog), the detection job (detect) and table-based jobs (jobs)."""
