"""DataFrame operators of the scanner."""
