"""Batch jobs: shared inputs computed once, several result tables written."""
