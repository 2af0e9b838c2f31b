"""operators of the gridded-data engine."""
