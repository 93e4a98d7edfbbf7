"""Stores and readers."""
