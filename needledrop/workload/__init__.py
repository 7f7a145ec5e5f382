"""The registered queries: every operator over the given tables, and its SQL check."""
