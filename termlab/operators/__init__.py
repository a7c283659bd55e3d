"""DataFrame-to-DataFrame operators, one module per stage."""
