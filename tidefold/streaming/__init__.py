"""Structured Streaming forms of the folds: they give what the batch forms give."""
