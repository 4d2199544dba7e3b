"""Column expressions: Python-style text, type guessing, dates and validation rules."""
