"""End-to-end queries."""
