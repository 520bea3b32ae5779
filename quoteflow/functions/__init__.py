"""Column functions: text, codes, dates and money as native expressions."""
