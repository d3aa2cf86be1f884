"""Readers of landed pages and documents, and writers of reports."""
