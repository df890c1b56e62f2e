"""operators of the text-reuse library."""
