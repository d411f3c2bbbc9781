"""Readers, writers and source discovery."""
