"""Column expressions: missing values, bins, scalar formulas."""
