"""Readers and writers of layout documents and text collections."""
