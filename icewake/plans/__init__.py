"""icewake.plans."""
