"""Tidemill: a PySpark-native engine for state, conversation and reliability analytics."""
