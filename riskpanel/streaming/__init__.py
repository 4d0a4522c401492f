"""Incremental collection: skip what is there, append months, merge new visits."""
