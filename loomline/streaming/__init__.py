"""Matching and parsing of streams."""
