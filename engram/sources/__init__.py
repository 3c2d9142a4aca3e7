"""Readers, adapters, a registry of external sources, and the graph bundle."""
