"""Readers, sinks and explicit schemas."""
