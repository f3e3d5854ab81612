"""functions of the revision-archive engine."""
