"""Readers that turn files and payloads into rows."""
