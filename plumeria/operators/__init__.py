"""Relational operators over comments, lookup tables and clusters."""
