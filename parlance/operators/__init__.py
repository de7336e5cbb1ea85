"""Parlance operators."""
