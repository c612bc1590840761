"""models of eventloom."""
