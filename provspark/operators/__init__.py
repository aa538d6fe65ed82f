"""DataFrame operators on processing records."""
