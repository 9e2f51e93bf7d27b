"""Column builders: predicates, text functions, vectors, and user-defined kernels."""
