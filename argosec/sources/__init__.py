"""sources of the security engine."""
