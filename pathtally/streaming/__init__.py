"""Streams of new paths."""
