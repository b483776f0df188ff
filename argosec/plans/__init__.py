"""plans of the security engine."""
