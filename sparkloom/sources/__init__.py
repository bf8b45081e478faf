"""Readers, writers and ingest functions."""
