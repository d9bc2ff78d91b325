"""Column expressions and the naming rules they follow."""
