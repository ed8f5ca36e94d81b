"""Whole plans: parsing a table of messages."""
