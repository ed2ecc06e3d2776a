"""Readers: tables, file listings, headers, pixels, text dumps."""
