"""Column expressions: text, numbers, dates, criteria and string similarity."""
