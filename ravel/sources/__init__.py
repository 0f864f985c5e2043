"""Scans and domain views."""
