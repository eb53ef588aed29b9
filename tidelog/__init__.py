"""Edition-versioned relational analytics on PySpark."""
