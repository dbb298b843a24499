"""Stores and streaming queries."""
