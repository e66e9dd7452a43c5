"""DataFrame operators of the release audit."""
