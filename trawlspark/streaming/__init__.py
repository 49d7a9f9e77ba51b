"""Incremental forms of builds and state, by Structured Streaming. An extension: the batch operators are complete without."""
