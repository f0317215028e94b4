"""functions of the timed-text library."""
