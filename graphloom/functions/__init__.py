"""Column functions with the exact semantics that identities and scores depend on."""
