"""Leakage-safe training sets from structural-biology tables, as functions from DataFrame to DataFrame."""
