"""Column functions: columns in, one column out."""
