"""A fluent, model-aware query engine that compiles to PySpark DataFrames."""
