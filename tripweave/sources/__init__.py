"""Payload readers, table readers and writers, row export."""
