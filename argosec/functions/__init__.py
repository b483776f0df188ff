"""Scalar functions of the security engine."""
