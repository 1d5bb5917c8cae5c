"""Pixel helpers: NumPy only, no Spark."""
