"""How often pairs of items occur in the same basket, and how much more often than by chance.

An ordinary basket is multiplied out within one task. A huge one is split into chunks of its items, and
each pair of chunks is a unit of work of its own, so its quadratic number of pairs is spread over many
tasks. A unit has a budget of pairs, from which the size of a chunk follows; units are bundled up to a
budget of pairs a call. Tasks count in accumulators of item pairs and send one row per pair, not one per
occurrence, for the products of chunks as for ordinary baskets.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.session import ship, stored

#: Pairs of one unit of work. A chunk has the square root of it in items; a basket of more items is huge.
UNIT_PAIRS = 1_024
#: Pairs of the units that are multiplied and counted in one call.
BUNDLE_PAIRS = 2_000_000
#: Pairs gathered by a task before they are counted, and counted pairs it holds before it sends them on.
GATHER = 2_000_000
HOLD = 4_000_000
#: Counted rows up to which a table of huge baskets or of items may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Shares of the items of a huge basket that meet its size in a join by (basket, share).
SHARES = 256

_SCHEMA = "item_a bigint, item_b bigint, n bigint"


class _Pairs:
    """Counts of (a, b); sorted runs are merged as they come."""

    def __init__(self):
        self.a = self.b = self.n = np.zeros(0, np.int64)
        self.wait: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.wait.append((np.minimum(a, b), np.maximum(a, b)))
        self.waiting += len(a)
        if self.waiting >= GATHER:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        a = np.concatenate([self.a, *[x for x, _ in self.wait]])
        b = np.concatenate([self.b, *[y for _, y in self.wait]])
        n = np.concatenate([self.n, np.ones(self.waiting, np.int64)])
        items = np.unique(np.concatenate([a, b]))  # the task's own dictionary of items
        code = np.searchsorted(items, a) * len(items) + np.searchsorted(items, b)
        pairs, inverse = np.unique(code, return_inverse=True)
        self.n = np.bincount(inverse, weights=n, minlength=len(pairs)).astype(np.int64)
        self.a, self.b = items[pairs // len(items)], items[pairs % len(items)]
        self.wait, self.waiting = [], 0

    def batch(self) -> pa.RecordBatch:
        self.settle()
        out = pa.RecordBatch.from_arrays([pa.array(self.a), pa.array(self.b), pa.array(self.n)], names=["item_a", "item_b", "n"])
        self.a = self.b = self.n = np.zeros(0, np.int64)
        return out


def _within(items: np.ndarray, sizes: np.ndarray):
    """All pairs inside consecutive baskets, GATHER or so at a time; baskets of one size at once."""
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        rows = starts[sizes == size]
        per = max(1, GATHER // len(i))
        for k in range(0, len(rows), per):
            m = items[rows[k : k + per, None] + np.arange(size)]
            yield m[:, i].ravel(), m[:, j].ravel()


def _ordinary(batches):
    """Rows (basket, item) sorted by basket; a basket may go on in the next batch."""
    pairs, rest_b, rest_i = _Pairs(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def count(b, i):
        if len(b):
            cuts = np.flatnonzero(np.diff(b)) + 1
            for x, y in _within(i, np.diff(np.concatenate([[0], cuts, [len(b)]]))):
                pairs.add(x, y)

    for batch in batches:
        b = np.concatenate([rest_b, batch.column(0).to_numpy()])
        i = np.concatenate([rest_i, batch.column(1).to_numpy()])
        last = np.searchsorted(b, b[-1]) if len(b) else 0
        count(b[:last], i[:last])
        rest_b, rest_i = b[last:], i[last:]
        if len(pairs.n) > HOLD:
            yield pairs.batch()
    count(rest_b, rest_i)
    yield pairs.batch()


def _unit_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Units (basket, i, j) as rows of three columns, and the items, sorted by unit."""
    key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in (0, 1, 2)], axis=1)
    item = t.column(3).to_numpy()
    order = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
    return key[order], item[order]


def _blocks(left: pa.Table, right: pa.Table) -> pa.Table:
    """The products of the chunk pairs in a bundle of units, counted: each left item of a unit with each right one;
    a unit of a chunk with itself gives its pairs once."""
    pairs = _Pairs()
    if left.num_rows and right.num_rows:
        (lk, x), (rk, y) = _unit_rows(left.select(["of", "i", "j", "left"])), _unit_rows(right.select(["basket", "i", "j", "right"]))
        units, unit = np.unique(np.concatenate([lk, rk]), axis=0, return_inverse=True)
        lu, ru = unit.reshape(-1)[: len(lk)], unit.reshape(-1)[len(lk) :]
        n = np.bincount(ru, minlength=len(units))
        begin = np.cumsum(n) - n
        ends = np.cumsum(n[lu])
        at = 0
        while at < len(x):  # rows of left items, so many that about GATHER pairs come of them
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GATHER, side="right")))
            m = n[lu[at:upto]]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            a, b = np.repeat(x[at:upto], m), y[np.repeat(begin[lu[at:upto]], m) + within]
            own = np.repeat(lk[at:upto, 1] == lk[at:upto, 2], m)
            use = ~own | (a < b)
            pairs.add(a[use], b[use])
            at = upto
    return pa.Table.from_batches([pairs.batch()])


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """``basket, item``, each once; rows with a null in either are dropped."""
    return rows.select(F.col(basket).cast("bigint").alias("basket"), F.col(item).cast("bigint").alias("item")).where("basket IS NOT NULL AND item IS NOT NULL").distinct()


def pair_counts(held: DataFrame, unit_pairs: int = UNIT_PAIRS, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """(``item_a, item_b, n`` (item_a < item_b) over distinct (basket, item) rows: baskets with both; the number of
    huge baskets, whose pairs came as products of chunks)."""
    spark = held.sparkSession
    ship(spark)
    chunk, seen = max(1, isqrt(unit_pairs)), Observation()
    sizes = held.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size") > chunk)
    huge = stored(sizes.select("basket", F.ceil(F.col("size") / chunk).cast("int").alias("n_chunks"), "size"), seen, n=F.count("*"), pairs=F.sum(F.expr("CAST(size AS DOUBLE) * size / 2")))
    n_huge, block_pairs = seen.get["n"] or 0, seen.get["pairs"] or 0.0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = huge.select("basket", "n_chunks")
    if not n_huge:
        marked = held.withColumn("n_chunks", F.lit(None).cast("int"))
    elif n_huge <= broadcast_rows:
        marked = held.join(F.broadcast(mark), "basket", "left")
    else:  # by (basket, share): the rows of a huge basket meet its size in SHARES places
        wide = mark.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))))
        marked = held.withColumn("share", F.pmod(F.xxhash64("item"), F.lit(SHARES))).join(wide, ["basket", "share"], "left")
    small = marked.where("n_chunks IS NULL").select("basket", "item")
    counted = small.repartition(partitions, "basket").sortWithinPartitions("basket").mapInArrow(_ordinary, _SCHEMA)
    if n_huge:
        # The chunk of an item is the hash of basket and item, so no task needs the whole basket.
        bundles = max(1, min(2**31 - 1, int(block_pairs / BUNDLE_PAIRS) + 1))
        big = marked.where("n_chunks IS NOT NULL").withColumn("k", F.pmod(F.xxhash64("basket", "item"), F.col("n_chunks")).cast("int"))
        as_left = big.withColumn("j", F.explode(F.sequence(F.col("k"), F.col("n_chunks") - 1))).select(F.col("basket").alias("of"), F.col("k").alias("i"), "j", F.col("item").alias("left"))
        as_right = big.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).select("basket", "i", F.col("k").alias("j"), F.col("item").alias("right"))
        of = lambda b: F.pmod(F.xxhash64(b, "i", "j"), F.lit(bundles)).alias("bundle")
        both = as_left.withColumn("u", of("of")).groupBy("u").cogroup(as_right.withColumn("v", of("basket")).groupBy("v"))
        counted = counted.unionByName(both.applyInArrow(_blocks, _SCHEMA))
    return counted.groupBy("item_a", "item_b").agg(F.sum("n").alias("n")), n_huge


def associations(rows: DataFrame, basket: str = "src", item: str = "dst", unit_pairs: int = UNIT_PAIRS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``item_a, item_b, n_both, n_a, n_b, n_baskets, lift, pmi`` of every pair that shares a basket.

    An item counts once in a basket. lift is n_both * n_baskets / (n_a * n_b), the ratio of the baskets
    with both to those expected by chance, pmi its binary logarithm. The table of item counts is broadcast
    if it has at most ``broadcast_rows`` rows, else joined.
    """
    held, counted = stored(baskets(rows, basket, item)), Observation()
    per_item = stored(held.groupBy("item").agg(F.count("*").alias("c")), counted, n=F.count("*"))
    n = held.select("basket").distinct().count()
    hint = F.broadcast if (counted.get["n"] or 0) <= broadcast_rows else (lambda d: d)
    a = hint(per_item.select(F.col("item").alias("item_a"), F.col("c").alias("n_a")))
    b = hint(per_item.select(F.col("item").alias("item_b"), F.col("c").alias("n_b")))
    both = pair_counts(held, unit_pairs, broadcast_rows)[0].withColumnRenamed("n", "n_both").join(a, "item_a").join(b, "item_b")
    lift = F.col("n_both") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))
    return both.select("item_a", "item_b", "n_both", "n_a", "n_b", F.lit(n).cast("bigint").alias("n_baskets"), lift.alias("lift"), F.log2(lift).alias("pmi"))
