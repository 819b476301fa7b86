"""Training-data operators.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
