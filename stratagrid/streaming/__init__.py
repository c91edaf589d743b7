"""Streaming of the spatio-temporal engine."""
