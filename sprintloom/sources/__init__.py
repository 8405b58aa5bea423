"""Stored tables and landed raw documents."""
