"""Column expressions shared by batch and stream; all of them stay in the JVM."""
