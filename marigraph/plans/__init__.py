"""Composed queries over the operators, registered by name."""
