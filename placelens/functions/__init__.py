"""functions of placelens."""
