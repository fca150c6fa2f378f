"""Incremental forms of event extraction and of working on new matches."""
