"""Parlance sources."""
