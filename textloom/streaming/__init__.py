"""streaming of the text engine."""
