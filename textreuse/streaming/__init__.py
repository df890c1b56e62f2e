"""streaming of the text-reuse library."""
