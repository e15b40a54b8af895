"""Column functions: text, URLs, vectors, codecs."""
