"""Column functions that stay inside the JVM, plus the model hooks."""
