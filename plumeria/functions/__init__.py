"""Column functions: text, dates, labels."""
