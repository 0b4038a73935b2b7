"""Waymark streaming."""
