"""plans of the text-reuse library."""
