"""Audits of files and events as they arrive."""
