"""The measurement view, the query registry and the queries."""
