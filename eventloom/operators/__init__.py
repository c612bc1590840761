"""operators of eventloom."""
