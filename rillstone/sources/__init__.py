"""Readers and writers: landed payloads, inventory text, files."""
