"""Column -> Column building blocks, all evaluated in the JVM."""
