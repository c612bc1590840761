"""functions of eventloom."""
