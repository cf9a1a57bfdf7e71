"""Whole jobs composed from operators: what an analyst calls."""
