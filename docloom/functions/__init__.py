"""Column functions: text cleaning and tests, vectors, JSON and numbers; Arrow functions where order or matching needs Python."""
