"""Language front ends: source text to syntax rows."""
