"""Column expressions shared by the operators; everything is built from Spark SQL functions."""
