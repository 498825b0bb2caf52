"""Column builders (all JVM-side built-in functions, no UDFs)."""
