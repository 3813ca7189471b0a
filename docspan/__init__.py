"""Document queries on Spark: collections of typed rows or JSON documents, a compact query language and a fluent API."""
