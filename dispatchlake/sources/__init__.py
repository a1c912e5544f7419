"""Readers and writers: capture files, manifests, typed tables."""
