"""sources of eventloom."""
