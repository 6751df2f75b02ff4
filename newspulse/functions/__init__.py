"""Column-level building blocks; all of them run inside the JVM."""
