"""Readers and writers for dated conversations, claims and append-only logs."""
