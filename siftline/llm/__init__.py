"""Operators for preparing large text corpora; nothing else in siftline imports this package."""
