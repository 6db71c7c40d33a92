"""Relational operators over governed tables."""
