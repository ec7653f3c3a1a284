"""Schemas of raw payloads, readers and sinks."""
