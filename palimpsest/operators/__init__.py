"""operators of the revision-archive engine."""
