"""operators of placelens."""
