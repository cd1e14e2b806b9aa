"""Retrieval and corpus analytics as DataFrame to DataFrame operators."""
