"""Sources of the evidence engine."""
