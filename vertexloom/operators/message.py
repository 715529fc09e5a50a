"""Gather, scatter, combine, apply and change detection as relational steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.skew import BROADCAST_BYTES, ROWS_PER_TASK, hot_keys, replicated, salted
from vertexloom.session import discard, stored


def row_bytes(width: int) -> int:
    """Bytes a broadcast holds for a row of a key and ``width`` fixed-width values."""
    return 32 + 8 * width


class EdgeIndex:
    """Edges prepared once for many joins with a vertex state of one row per id and ``width`` values.

    While the state fits ``broadcast_bytes`` (nv is known exactly, and so is the width) it is broadcast and
    the edges stay where the scan put them, so a hot vertex costs nothing; with ``keep`` they are cached in
    columns for the rounds of a loop (a lost part is computed again). Beyond, the edges are hash
    partitioned once by (src, salt) and kept; each round shuffles only the state. Sources with more
    than ``rows_per_task`` edges get as many salts as they need, and only their state rows are repeated.

    With ``by_source`` the edges are also laid out in order of their source, written once, so that a push
    from a few ranges of ids reads only the row groups that hold them.
    """

    def __init__(self, g: Graph, width: int = 1, broadcast_bytes: int = BROADCAST_BYTES, rows_per_task: int = ROWS_PER_TASK, keep: bool = False, by_source: bool = False):
        self.g, self.keep = g, keep
        self.small = g.nv * row_bytes(width) <= broadcast_bytes
        self.hot = self.hot_dst = self.laid = self.by_source = None
        if by_source:
            self.laid = stored(g.edges.repartitionByRange("src").sortWithinPartitions("src"))
            self.by_source = self.laid.persist() if keep and self.small else self.laid
        if self.small:
            self.edges = self.by_source if by_source else g.edges.persist() if keep else g.edges
        else:
            self.hot = hot_keys(g.edges, "src", rows_per_task).persist()
            self.hot_dst = hot_keys(g.edges, "dst", rows_per_task).persist()
            n = int(g.spark.conf.get("spark.sql.shuffle.partitions"))
            self.edges = salted(g.edges, "src", "dst", self.hot).repartition(n, "src", "_salt").persist()

    def mark_sources(self, state: DataFrame) -> DataFrame:
        """``state`` with ``_source``: whether an edge leaves the vertex. Done once; a loop carries the column, so
        that its rounds move only the states some edge reads (a semi-join paid for once)."""
        s = self.edges.select(F.col("src").alias("_id")).distinct()
        return state.join(s, F.col("id") == F.col("_id"), "left").withColumn("_source", F.col("_id").isNotNull()).drop("_id")

    def gather(self, state: DataFrame) -> DataFrame:
        """Edges joined with the state of their source: src, dst[, weight] and the state's columns.

        ``state`` has a column id and at most one row per id; edges whose source has no row drop out.
        """
        s = state.withColumnRenamed("id", "_id")
        if self.small:
            return self.edges.join(F.broadcast(s), F.col("src") == F.col("_id")).drop("_id", "_salt")
        s = replicated(s, "_id", self.hot, "src").withColumnRenamed("_salt", "_s")
        return self.edges.join(s, (F.col("src") == F.col("_id")) & (F.col("_salt") == F.col("_s"))).drop("_id", "_s", "_salt")

    def scatter(self, front: DataFrame, within: Column | None = None) -> DataFrame:
        """As ``gather`` for a front of few (counted) rows, which is broadcast to the edges by source; ``within``
        is a range condition on src that no id of the front fails."""
        e = self.by_source if within is None else self.by_source.where(within)
        return e.join(F.broadcast(front.withColumnRenamed("id", "_id")), F.col("src") == F.col("_id")).drop("_id")

    def with_target(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        """``rows`` (with dst) joined with the state of their target."""
        s = state.withColumnRenamed("id", "_id")
        if self.small:
            return rows.join(F.broadcast(s), F.col("dst") == F.col("_id")).drop("_id")
        s = replicated(s, "_id", self.hot_dst, "dst").withColumnRenamed("_salt", "_s")
        r = salted(rows, "dst", "src", self.hot_dst)
        return r.join(s, (F.col("dst") == F.col("_id")) & (F.col("_salt") == F.col("_s"))).drop("_id", "_s", "_salt")

    def release(self) -> None:
        """Free what was cached and written; frames made of the index are of no use afterwards."""
        for x in (self.edges, self.by_source, self.hot, self.hot_dst):
            if x is not None and (self.keep or not self.small):
                x.unpersist()
        discard(self.laid)


def combine(messages: DataFrame, how: str, value: str = "msg", key: str = "dst") -> DataFrame:
    """``key`` → ``id`` with the sum, min or max of ``value``; combined on the map side."""
    f = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    return messages.groupBy(F.col(key).alias("id")).agg(f(value).alias(value))


def gather_step(index: EdgeIndex, state: DataFrame, message: Column, how: str) -> DataFrame:
    """One pull step without apply: ``id, msg`` of every vertex that has an in-edge."""
    return combine(index.gather(state).select("dst", message.alias("msg")), how)


def apply_step(state: DataFrame, messages: DataFrame, how: str, cols: list[str], pick=F.max) -> DataFrame:
    """State rows and messages in one aggregation: ``id``, the state's ``cols`` and ``msg`` (null if none).
    If the state has several rows for an id, ``pick`` is the aggregate that chooses among their values.

    ``messages`` (id, msg) need not be combined before: a union and a group-by take one exchange, to which
    each task sends at most one row per target, where combining and a left join take two or three.
    """
    f = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    types = dict(messages.dtypes)
    a = state.select("id", *cols, F.lit(None).cast(types["msg"]).alias("msg"))
    b = messages.select("id", *[F.lit(None).cast(dict(state.dtypes)[c]).alias(c) for c in cols], "msg")
    return a.unionByName(b).groupBy("id").agg(*[pick(c).alias(c) for c in cols], f("msg").alias("msg"))


def changed(old: DataFrame, new: DataFrame, value: str = "label") -> DataFrame:
    """``id, old, new`` of the vertices whose value differs between two states."""
    o, n = old.select("id", F.col(value).alias("old")), new.select("id", F.col(value).alias("new"))
    return o.join(n, "id").where(~F.col("old").eqNullSafe(F.col("new")))


def semi_load(edges: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of ``state`` whose id is the source of at least one edge: what a part of the graph has to load."""
    return state.join(edges.select(F.col("src").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_semi")
