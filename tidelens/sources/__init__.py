"""Scans, schema checks, normalisation to the canonical frames, and sinks."""
