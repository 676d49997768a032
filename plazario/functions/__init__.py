"""Scalar column functions (text, dates, URLs, places)."""
