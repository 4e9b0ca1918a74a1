"""Scalar functions: cleaning, typing, text and match features, as column expressions."""
