"""Column expressions and the rule language."""
