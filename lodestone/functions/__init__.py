"""Column builders: fixed values, rules and text functions."""
