"""operators of the security engine."""
