"""Point-in-time sports analytics on Spark: every feature of a match uses only what was known strictly before it."""
