"""Column functions on text, numbers and geometry."""
