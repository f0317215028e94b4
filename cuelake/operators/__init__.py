"""operators of the timed-text library."""
