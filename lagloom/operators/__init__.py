"""DataFrame to DataFrame operators; all are lazy."""
