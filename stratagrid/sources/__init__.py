"""Sources of the spatio-temporal engine."""
