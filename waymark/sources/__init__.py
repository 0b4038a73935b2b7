"""Waymark sources."""
