"""Column builders: each takes and returns Spark columns and stays in the JVM unless it says so."""
