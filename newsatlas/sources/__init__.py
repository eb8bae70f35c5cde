"""Readers, HTML extraction and writers."""
