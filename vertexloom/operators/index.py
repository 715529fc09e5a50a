"""Prefix sums: compressed-sparse offsets without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.degree import in_degree, out_degree

#: At most so many blocks; the table of block totals has one row each and may be broadcast.
BLOCKS = 4096


def prefix_sum(df: DataFrame, n: int, value: str, out: str, blocks: int = BLOCKS) -> DataFrame:
    """Inclusive running sum of ``value`` over ``id`` (dense, 0..n-1, one row each) as ``out``.

    The ids are cut into equal blocks; a window runs inside each block, and the totals of the earlier
    blocks (at most ``blocks`` rows) are added. No task sees more than one block at a time.
    """
    size = max(1, -(-n // blocks))
    d = df.withColumn("_block", F.floor(F.col("id") / F.lit(size)))
    totals = d.groupBy("_block").agg(F.sum(value).alias("_t"))
    before = totals.select(
        "_block", F.coalesce(F.sum("_t").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    w = Window.partitionBy("_block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.join(F.broadcast(before), "_block").withColumn(out, F.sum(value).over(w) + F.col("_before")).drop("_block", "_before")


def block_sums(df: DataFrame, id: str, n: int, value: str, out: str, first: list[str], blocks: int = BLOCKS) -> DataFrame:
    """Inclusive running sum of ``value`` in order of the few-valued ``first`` columns, then of ``id`` (0..n-1, with
    gaps); as ``prefix_sum``, at most ``blocks`` blocks for each value of ``first``."""
    d = df.withColumn("_block", F.floor(F.col(id) / F.lit(max(1, -(-n // blocks)))))
    totals = d.groupBy(*first, "_block").agg(F.sum(value).alias("_t"))
    w = Window.orderBy(*first, "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*first, "_block", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*first, "_block").orderBy(id).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.join(F.broadcast(before), [*first, "_block"]).withColumn(out, F.sum(value).over(inner) + F.col("_before")).drop("_block", "_before")


def csc_offsets(g: Graph) -> DataFrame:
    """``id, in_degree, in_end``: the end offset of each vertex's block of in-edges."""
    return prefix_sum(in_degree(g), g.nv, "in_degree", "in_end")


def csr_offsets(g: Graph) -> DataFrame:
    """``id, out_degree, out_end``: the end offset of each vertex's block of out-edges."""
    return prefix_sum(out_degree(g), g.nv, "out_degree", "out_end")


def vertices_table(g: Graph) -> DataFrame:
    """``id, in_end, out_degree`` in one exchange of counts."""
    e = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    z = g.vertices.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"))
    both = e.unionByName(z).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return prefix_sum(both, g.nv, "in_degree", "in_end").select("id", "in_end", "out_degree")


def sorted_edges(g: Graph) -> DataFrame:
    """Edges in file order: by (dst, src[, weight]), range-partitioned, so a hot dst spans partitions."""
    return g.edges.orderBy("dst", "src", *(["weight"] if g.weighted else []))


def transpose(g: Graph) -> DataFrame:
    """Edges laid out by source (the push layout); logically the same rows."""
    return g.edges.orderBy("src", "dst")
