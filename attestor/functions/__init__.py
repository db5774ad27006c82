"""Column functions: validated scalar types, text clean-up, and tolerant reply parsing."""
