"""plans of eventloom."""
