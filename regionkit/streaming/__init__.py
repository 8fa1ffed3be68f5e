"""Streaming forms of the resumable run."""
