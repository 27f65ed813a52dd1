"""Column -> Column expressions: text, taxonomy parsing, numbers, dates, paths."""
