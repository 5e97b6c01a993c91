"""functions of the text engine."""
