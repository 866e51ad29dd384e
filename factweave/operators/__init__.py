"""Relational and graph operators over evidence tables."""
