"""Column expressions, fixed values and contract checks shared by the operators."""
