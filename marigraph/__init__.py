"""Spark-native analytics for tide, current, sun and moon series and for station catalogs."""
