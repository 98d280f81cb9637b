"""A PySpark-native engine for curated, multi-valued catalogue data."""
