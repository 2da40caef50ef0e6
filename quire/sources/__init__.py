"""Readers: files to rows of text nodes with native addresses."""
