"""Column -> Column builders; everything here stays inside the JVM except ``programs.run_assignments``."""
