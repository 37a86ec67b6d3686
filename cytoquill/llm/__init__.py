"""Operators for preparing training text: mixing, near duplicates, sharding, filtering, encoding."""
