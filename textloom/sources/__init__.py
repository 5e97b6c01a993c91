"""sources of the text engine."""
