"""Column expressions and fused statistics."""
