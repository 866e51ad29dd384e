"""Readers, bindings and sinks."""
