"""Operators of the spatio-temporal engine."""
