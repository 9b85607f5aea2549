"""Column -> Column building blocks, all JVM-side."""
