"""icewake.functions."""
