"""streaming of the gridded-data engine."""
