"""operators of the text engine."""
