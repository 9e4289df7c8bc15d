"""DataFrame operators shared by the queries."""
