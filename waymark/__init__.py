"""Waymark: a location and event analytics engine on the public PySpark DataFrame, SQL and Structured Streaming APIs."""
