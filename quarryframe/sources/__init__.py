"""Readers, scanners and sinks."""
