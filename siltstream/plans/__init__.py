"""Plan-level helpers shared by the operators."""
