"""Tessella: a PySpark-native engine for checkable document analytics."""
