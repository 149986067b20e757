"""Column functions: regular expressions with offsets, validators, labels."""
