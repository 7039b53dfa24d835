"""Scans of file formats and writers of result tables."""
