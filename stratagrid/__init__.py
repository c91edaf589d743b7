"""Spatio-temporal range search and keyword-restricted joins as DataFrame operations."""
