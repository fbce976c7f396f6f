"""Readers and writers of event logs, drift tables and results."""
