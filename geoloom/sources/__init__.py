"""Readers of the archive's inputs, always with explicit schemas."""
