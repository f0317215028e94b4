"""streaming of the timed-text library."""
