"""Column builders for document values: paths, kinds, numeric coercion, comparison."""
