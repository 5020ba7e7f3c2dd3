"""DataFrame operators, keyed by sample or image."""
