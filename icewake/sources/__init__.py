"""icewake.sources."""
