"""Readers and writers: raw text tables, Parquet zones, manifests, evidence files."""
