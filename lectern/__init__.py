"""lectern: full-text and metadata search over document tables, on Spark."""
