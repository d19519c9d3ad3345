"""Column helpers and distributed kernels shared by the operators."""
