"""Readers, state tables and sinks."""
