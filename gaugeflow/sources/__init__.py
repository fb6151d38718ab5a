"""Readers that bring capture files to long tables, and writers of reports."""
