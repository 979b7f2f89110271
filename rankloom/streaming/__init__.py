"""Activity features over streams."""
