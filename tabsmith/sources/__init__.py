"""Readers, sinks and stored records."""
