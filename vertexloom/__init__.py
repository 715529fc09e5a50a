"""vertexloom: graph analytics and large-scale data operators as Spark DataFrame plans."""

from vertexloom.graph import Graph

__all__ = ["Graph"]
