"""Column expressions: text, URLs, salaries, categories and raw HTML."""
