"""Readers and writers for listing snapshots, lookup tables and points of interest."""
