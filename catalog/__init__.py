"""Queries of the operator library over the benchmark tables, with their SQL twins."""
