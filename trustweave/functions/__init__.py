"""Column helpers: geometry, scores, canonical text and hashes."""
