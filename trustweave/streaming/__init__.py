"""Structured Streaming forms of the matching, smoothing and gating operators."""
