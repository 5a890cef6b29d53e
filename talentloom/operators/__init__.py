"""DataFrame operators, one module an area."""
