"""icewake.operators."""
