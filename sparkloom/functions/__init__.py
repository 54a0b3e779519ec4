"""Column -> Column expressions; all of them stay inside code generation."""
