"""Readers for the tables and files that the audit covers."""
