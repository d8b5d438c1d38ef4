"""Readers and writers of sequence, table and tree files."""
