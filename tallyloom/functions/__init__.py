"""Column-level helpers built from JVM-side Spark functions."""
