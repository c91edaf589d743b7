"""Plans of the spatio-temporal engine."""
