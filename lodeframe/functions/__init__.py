"""Column functions: geometry, hashing and colours."""
