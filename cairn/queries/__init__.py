"""The registered queries and their SQL checks, by module."""
