"""Column functions: text, labels, reply decoding and row scores."""
