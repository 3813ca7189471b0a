"""The query language: text to syntax tree, syntax tree to DataFrame."""
