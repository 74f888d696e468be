"""Column expressions. All are built-in Spark expressions except ``normal.two_sided_p``."""
