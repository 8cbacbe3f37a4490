"""Column expressions: cleaning, typing, keys and pseudonyms. All JVM-side."""
