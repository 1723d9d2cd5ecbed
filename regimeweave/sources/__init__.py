"""Readers and writers of candles, manifests, vectors, reports and file listings."""
