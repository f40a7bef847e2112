"""Column functions: months, money, text."""
