"""Streaming forms of the window and verdict jobs."""
