"""Streams of documents and of feedback."""
