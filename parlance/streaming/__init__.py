"""Parlance streaming."""
