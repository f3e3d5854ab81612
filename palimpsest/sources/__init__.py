"""sources of the revision-archive engine."""
