"""Readers, normalizers, ledgers and published tables."""
