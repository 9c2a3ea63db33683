"""Column functions: text, boxes, rounding."""
