"""Column expressions for messy text, numbers, dates and keys."""
