"""Scans, writers and manifests of document collections."""
