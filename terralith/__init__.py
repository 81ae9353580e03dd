"""terralith: relational geometry, potential fields and survey statistics on PySpark."""
