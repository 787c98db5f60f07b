"""Readers of station catalogs, events, constituents and moon phases; each returns a relation of ``marigraph.schemas``."""
