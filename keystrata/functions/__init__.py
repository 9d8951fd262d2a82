"""Column functions: hashes and codecs."""
