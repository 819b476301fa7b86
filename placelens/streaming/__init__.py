"""streaming of placelens."""
