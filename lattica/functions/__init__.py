"""Scalar functions: text, JSON trees, claims and overlap scores."""
