"""Column expressions: parsing, text cleaning, matching, display."""
