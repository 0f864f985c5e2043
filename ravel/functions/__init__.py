"""Column helpers (JVM-side expressions only; no Python UDFs)."""
