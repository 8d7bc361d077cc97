"""Column builders: guarded rolling windows, ranks, returns and the like."""
