"""plans of the revision-archive engine."""
