"""Readers and writers at the edges."""
