"""Scalar, ordering and graph helpers used by the operators."""
