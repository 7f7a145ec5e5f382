"""Operators on streams of plays."""
