"""Column functions: every one is a native expression that stays inside code generation where Spark can."""
