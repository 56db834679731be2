"""Readers, writers and the bindings of the driver test tables."""
