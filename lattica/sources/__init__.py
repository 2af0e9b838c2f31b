"""sources of the gridded-data engine."""
