"""streaming of the security engine."""
