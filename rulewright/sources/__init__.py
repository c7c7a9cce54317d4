"""Readers of rules and events."""
