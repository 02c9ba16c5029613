"""Part of the findings library."""
