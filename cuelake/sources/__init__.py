"""sources of the timed-text library."""
