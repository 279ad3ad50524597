"""Incremental reading of verse, and its streaming form."""
