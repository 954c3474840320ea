"""Readers, writers and the adapter from the shared test tables to this data model."""
