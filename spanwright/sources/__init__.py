"""Readers of page images, recognised text, layouts and damaged JSON."""
