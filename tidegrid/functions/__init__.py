"""Column expressions and small numeric kernels shared by the operators."""
