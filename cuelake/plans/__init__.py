"""plans of the timed-text library."""
