"""Queries over the driver's tables, and the pipeline that composes the operators."""
