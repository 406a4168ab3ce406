"""Readers, fixture views over the driver's tables, and sinks."""
