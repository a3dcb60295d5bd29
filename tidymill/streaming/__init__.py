"""Steps on a streaming table."""
