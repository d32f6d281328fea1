"""DataFrame to DataFrame operators; all are lazy, and none holds state."""
