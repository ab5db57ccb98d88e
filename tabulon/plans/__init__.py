"""Ordered named steps and their refresh."""
