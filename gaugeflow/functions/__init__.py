"""Column expressions, all of Spark's own functions, so that they stay inside generated code."""
