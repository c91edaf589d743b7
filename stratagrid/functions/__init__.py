"""Functions of the spatio-temporal engine."""
