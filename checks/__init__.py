"""Registered queries and their SQL counterparts on the benchmark tables."""
