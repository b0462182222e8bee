"""Readers and writers for datasets, run logs and exports."""
