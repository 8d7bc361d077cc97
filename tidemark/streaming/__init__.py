"""The same bars and signals over streams."""
