"""plans of placelens."""
