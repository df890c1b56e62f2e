"""sources of the text-reuse library."""
