"""Text-reuse analytics on DataFrames: chunking, MinHash/LSH and cosine candidates, match groups, reports."""
