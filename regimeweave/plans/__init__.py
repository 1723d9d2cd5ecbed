"""Ready-made jobs over the standard tables."""
