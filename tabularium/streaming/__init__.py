"""Structured Streaming forms of operators, an extension beyond batch tables."""
