"""Operators on documents, spans, decisions and measurements."""
