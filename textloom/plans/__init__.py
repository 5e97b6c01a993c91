"""plans of the text engine."""
