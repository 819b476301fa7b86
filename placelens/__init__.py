"""placelens: analytics over catalogues of places, as functions from DataFrame to DataFrame."""
