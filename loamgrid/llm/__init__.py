"""Operators for large training corpora; each module holds one operator and its query."""
