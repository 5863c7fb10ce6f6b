"""Ordered-event analytics on Spark: entity -> session -> event."""
