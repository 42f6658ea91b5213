"""A PySpark engine for digest and reminder pipelines."""
