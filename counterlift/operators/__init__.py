"""User-level measurement operators: DataFrame(s) in, one DataFrame out."""
