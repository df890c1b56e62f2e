"""functions of the text-reuse library."""
