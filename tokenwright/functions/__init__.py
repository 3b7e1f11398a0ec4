"""Column functions: token counts and text helpers, all evaluated in the JVM."""
