"""Operators for preparing text, page and vector tables for model training."""
