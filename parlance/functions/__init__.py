"""Parlance functions."""
