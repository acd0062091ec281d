"""Log formats and the event table."""
