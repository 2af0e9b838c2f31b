"""plans of the gridded-data engine."""
