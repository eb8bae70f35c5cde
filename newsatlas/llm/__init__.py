"""Operators for preparing training text: language, archives, quality, scoring, duplicates, mixing and sharding."""
