"""icewake: polar voyage analytics expressed as Spark DataFrame jobs."""
