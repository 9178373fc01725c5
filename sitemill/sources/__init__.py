"""Readers of the domain's text formats, and writers."""
