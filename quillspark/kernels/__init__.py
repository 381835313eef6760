"""Pure-Python parsers, run inside Arrow-batched functions."""
