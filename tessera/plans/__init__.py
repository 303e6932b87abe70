"""Whole runs: approximate and exact search with evaluation (``comparison``)."""
