"""Building, validating, running and auditing plans."""
