"""Column-level functions (Column in, Column out), all Spark built-ins."""
