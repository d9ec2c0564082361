"""Readers, sinks and the bindings of the driver tables to entities."""
