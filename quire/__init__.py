"""quire: interval-indexed document analytics on PySpark."""
