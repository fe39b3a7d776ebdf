"""Manifests, series, volumes, reports, caches and configuration."""
