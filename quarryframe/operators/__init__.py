"""Distributed operators over the knowledge tables."""
