"""Column functions: text, records, vectors and small scalar rules."""
