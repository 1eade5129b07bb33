"""Incremental measurement of image sets as they arrive."""
