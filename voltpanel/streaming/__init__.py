"""Structured Streaming jobs: each run takes what has landed and stops."""
