"""Readers for landed payloads and stored tables."""
