"""Search operators over vector columns."""
