"""Column-expression helpers that stay inside whole-stage codegen."""
