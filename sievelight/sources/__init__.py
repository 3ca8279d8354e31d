"""Readers of source trees, rule packs, manifests and cached reports."""
