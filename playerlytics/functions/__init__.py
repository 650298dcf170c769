"""Column expressions: time semantics and event predicates (JVM-side built-ins only)."""
