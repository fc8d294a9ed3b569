"""Training-data operators: ten self-contained modules that nothing else in the library imports."""
