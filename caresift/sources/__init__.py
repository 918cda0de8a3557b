"""Readers, table discovery and writers."""
