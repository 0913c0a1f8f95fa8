"""Readers that keep every cell as text, and writers."""
