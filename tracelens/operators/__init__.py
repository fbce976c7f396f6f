"""DataFrame operators over event logs, windows and measures."""
