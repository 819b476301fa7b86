"""sources of placelens."""
