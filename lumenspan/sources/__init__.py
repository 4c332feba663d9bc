"""Readers and writers of files and services."""
