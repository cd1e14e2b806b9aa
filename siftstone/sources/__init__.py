"""Readers of tables, texts, code and streams."""
