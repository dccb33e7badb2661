"""Column expressions: text, numbers, dates and measures."""
