"""Column functions: text matching, fixed bands, measures."""
