"""Operators over problems: tables (id, x, y, ...) of labelled vectors."""
