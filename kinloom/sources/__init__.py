"""Reading person tables."""
