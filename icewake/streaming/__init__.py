"""icewake.streaming."""
