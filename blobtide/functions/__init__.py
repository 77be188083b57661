"""Column expressions. All are built-in Spark SQL expressions: no Python runs per row."""
