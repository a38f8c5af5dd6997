"""Session helpers and query planning."""
