"""Operators for preparing text and records as training data."""
