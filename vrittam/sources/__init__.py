"""Readers and writers of the corpus formats, with declared schemas."""
