"""Column-in, Column-out functions; none of them leaves the JVM."""
