"""Column functions: every one maps columns to a column and stays on the JVM side."""
