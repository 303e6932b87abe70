"""Grids and sketches, area MinHash, exact and approximate search, evaluation."""
