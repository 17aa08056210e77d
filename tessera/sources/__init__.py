"""Readers with explicit schemas and writers with committed output."""
