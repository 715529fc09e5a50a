"""Graph files: the binary compressed-sparse-column format and text edge lists."""
