"""Structured Streaming counterparts of directory watchers, and event-time windows (an extension)."""
