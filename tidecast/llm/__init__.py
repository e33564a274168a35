"""Operators for building language-model training data from raw tables."""
