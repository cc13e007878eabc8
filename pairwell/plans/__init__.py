"""Specifications: validated values, criteria and options that plans are built from."""
