"""Adapters from raw payloads and tables, and sinks."""
