"""functions of the gridded-data engine."""
