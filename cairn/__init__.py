"""A code-knowledge engine on PySpark DataFrames."""
