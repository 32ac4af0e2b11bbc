"""Readers and writers of files and scoring payloads."""
