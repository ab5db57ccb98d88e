"""Operators for preparing training text: near copies, extraction, counting, filtering, mixing and sharding."""
