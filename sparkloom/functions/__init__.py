"""Column functions: hashes and ids, statistics, text."""
