"""streaming of eventloom."""
