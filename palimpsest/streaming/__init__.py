"""streaming of the revision-archive engine."""
