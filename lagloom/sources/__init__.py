"""Readers, writers and the folders that a cluster shares."""
