"""Parlance plans."""
