"""Operators over step, presence and histogram tables."""
