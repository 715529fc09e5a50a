"""Per-key counts and aggregates when a few keys hold most of the rows.

Keys are dictionary-encoded to dense codes, each input split adds its rows into dense accumulator arrays
with numpy (bincount, scatter add / min / max), and the arrays are summed block by block in a distributed
reduction. A split sends at most one entry per key it holds, however many rows that key has, so a hot key
costs each reducer one entry a split and no task is bound to a key's rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.session import ship

#: Keys of one accumulator block (arrays of 512 KB).
BLOCK = 65_536
#: Array items a split may hold (128 MB). A larger domain is encoded by dictionary, as the keys of a split
#: are then far fewer than the keys there are.
DENSE_ITEMS = 16_000_000
#: Rows gathered before they are added to the arrays.
BUFFER = 1_000_000
#: Entries of a split's own dictionary at which it is sent on and begun anew.
DICTIONARY = 2_000_000

_I64 = np.iinfo(np.int64)


class _Dense:
    """Accumulators of one block: rows, and of the value rows, sum, least and greatest.

    Sums are 64-bit while what was added can't pass 63 bits whatever the keys; from then on they are whole
    numbers of any size, and one that doesn't fit in the end raises.
    """

    __slots__ = ("n", "m", "s", "lo", "hi", "room")

    def __init__(self, size: int, valued: bool):
        self.n = np.zeros(size, np.int64)
        if valued:
            self.m, self.s = np.zeros(size, np.int64), np.zeros(size, np.int64)
            self.lo, self.hi = np.full(size, _I64.max), np.full(size, _I64.min)
            self.room = _I64.max

    def plus(self, code: np.ndarray, v: np.ndarray) -> None:
        if len(v):
            self.room -= len(v) * max(abs(int(v.min())), abs(int(v.max())))
        if self.room < 0 and self.s.dtype != object:
            self.s = self.s.astype(object)
        np.add.at(self.s, code, v.astype(object) if self.s.dtype == object else v)

    def add(self, code: np.ndarray, value: np.ndarray | None, known: np.ndarray | None) -> None:
        self.n += np.bincount(code, minlength=len(self.n))
        if value is not None:
            c, v = code[known], value[known]
            self.m += np.bincount(c, minlength=len(self.n))
            self.plus(c, v)
            np.minimum.at(self.lo, c, v)
            np.maximum.at(self.hi, c, v)

    def merge(self, code: np.ndarray, cols: list[np.ndarray]) -> None:
        np.add.at(self.n, code, cols[0])
        if len(cols) > 1:
            np.add.at(self.m, code, cols[1])
            self.plus(code, cols[2])
            np.minimum.at(self.lo, code, cols[3])
            np.maximum.at(self.hi, code, cols[4])

    def columns(self, at: np.ndarray, valued: bool) -> list[np.ndarray]:
        if not valued:
            return [self.n[at]]
        sums = self.s[at]
        if sums.dtype == object:
            if any(not _I64.min <= x <= _I64.max for x in sums):
                raise OverflowError("the sum of a key passes 64 bits")
            sums = sums.astype(np.int64)
        return [self.n[at], self.m[at], sums, self.lo[at], self.hi[at]]


def _numpy(col, kind=np.int64) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def dense_key_aggregate(df: DataFrame, key: str, value: str | None = None, domain: int | None = None, reducers: int | None = None) -> DataFrame:
    """``key, n`` and, with an integer ``value``, ``n_values, sum, min, max`` for every key of ``df``.

    ``domain``: if the keys are integers of 0..domain-1, they are their own codes (no dictionary), blocks
    are contiguous ranges, and a split's block is one bincount; a key outside raises. Without a domain, or
    if its arrays would pass DENSE_ITEMS, integer keys are encoded by a dictionary of each split, whose
    entries are then placed in blocks by hash and encoded again there.

    Rows with a null key are left out. Null values count in n, not in n_values; a key without any value
    has null sum, min and max. A sum beyond 64 bits raises. An empty frame gives an empty result.
    A split is whatever partition ``df`` has (file splits, or a shuffle on another key): equal in size,
    whatever the keys.
    """
    spark = df.sparkSession
    ship(spark)
    valued = value is not None
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), *([F.col(value).cast("bigint").alias("x")] if valued else []))
    reducers = reducers or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dense = domain is not None and domain * (5 if valued else 1) <= DENSE_ITEMS
    partial = ["n"] + (["m", "s", "lo", "hi"] if valued else [])
    schema = "block bigint, code bigint, " + ", ".join(f"{c} bigint" for c in partial)

    def emit(block, code, cols):
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(code), *[pa.array(c) for c in cols]], names=["block", "code", *partial])

    def gathered(batches):
        """Arrow batches are small; the arrays are touched once for every BUFFER rows."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BUFFER:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def numbers(table):
        """Value and whether it is known, as numpy."""
        if not valued:
            return None, None
        return _numpy(pc.fill_null(table.column(1), 0)), _numpy(pc.is_valid(table.column(1)), bool)

    def split(batches):
        blocks: dict[int, _Dense] = {}
        for table in gathered(batches):
            code = _numpy(table.column(0))
            if len(code) and (code.min() < 0 or code.max() >= domain):
                raise ValueError(f"a key is outside 0..{domain - 1}")
            x, known = numbers(table)
            block = code // BLOCK
            order = np.argsort(block, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                b = int(block[rows[0]])
                acc = blocks.setdefault(b, None) or _Dense(BLOCK, valued)
                acc.add(code[rows] - b * BLOCK, x[rows] if valued else None, known[rows] if valued else None)
                blocks[b] = acc
        for b, acc in blocks.items():
            at = np.flatnonzero(acc.n)
            yield emit(np.full(len(at), b, np.int64), at + b * BLOCK, acc.columns(at, valued))

    def split_dictionary(batches):
        keys, parts = None, None  # sorted distinct keys so far, their accumulators
        for table in gathered(batches):
            d = pc.dictionary_encode(table.column(0).combine_chunks())
            own, code = _numpy(d.dictionary), _numpy(d.indices)
            acc = _Dense(len(own), valued)
            acc.add(code, *numbers(table))
            cols = acc.columns(np.arange(len(own)), valued)
            if keys is None:
                keys, parts = own, cols
            else:
                merged, inverse = np.unique(np.concatenate([keys, own]), return_inverse=True)
                total = _Dense(len(merged), valued)
                total.merge(inverse, [np.concatenate([a, b]) for a, b in zip(parts, cols)])
                keys, parts = merged, total.columns(np.arange(len(merged)), valued)
            if len(keys) > DICTIONARY:
                yield emit(_place(keys, reducers), keys, parts)
                keys = None
        if keys is not None and len(keys):
            yield emit(_place(keys, reducers), keys, parts)

    def reduce(batches):
        """Rows come sorted by block, so one block is held at a time."""
        now, code, cols = None, [], []
        if dense:
            acc = None
            for batch in batches:
                block = _numpy(batch.column(0))
                for rows in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1) if len(block) else []:
                    b = int(block[rows[0]])
                    if b != now:
                        if acc is not None:
                            at = np.flatnonzero(acc.n)
                            yield emit(np.full(len(at), now, np.int64), at + now * BLOCK, acc.columns(at, valued))
                        now, acc = b, _Dense(BLOCK, valued)
                    acc.merge(_numpy(batch.column(1))[rows] - b * BLOCK, [_numpy(batch.column(2 + i))[rows] for i in range(len(partial))])
            if acc is not None:
                at = np.flatnonzero(acc.n)
                yield emit(np.full(len(at), now, np.int64), at + now * BLOCK, acc.columns(at, valued))
            return

        def close():
            c = np.concatenate(code)
            keys, dense = np.unique(c, return_inverse=True)
            acc = _Dense(len(keys), valued)
            acc.merge(dense, [np.concatenate([x[i] for x in cols]) for i in range(len(partial))])
            return emit(np.full(len(keys), now, np.int64), keys, acc.columns(np.arange(len(keys)), valued))

        pending = 0
        for batch in batches:
            block = _numpy(batch.column(0))
            for rows in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1) if len(block) else []:
                b = int(block[rows[0]])
                if now is not None and b != now:
                    yield close()
                    code, cols, pending = [], [], 0
                now = b
                code.append(_numpy(batch.column(1))[rows])
                cols.append([_numpy(batch.column(2 + i))[rows] for i in range(len(partial))])
                pending += len(rows)
                if pending > 4_000_000:  # fold what came so far into one entry a key
                    done = close()
                    code = [_numpy(done.column(1))]
                    cols = [[_numpy(done.column(2 + i)) for i in range(len(partial))]]
                    pending = len(code[0])
        if now is not None:
            yield close()

    sent = src.mapInArrow(split if dense else split_dictionary, schema)
    if dense:  # no more reducers than blocks
        reducers = max(1, min(reducers, -(-domain // BLOCK) * 4))
        sent = sent.withColumn("part", F.floor(F.col("code") / (BLOCK // 4))).repartition(reducers, "part").drop("part")
    else:
        sent = sent.repartition(reducers, "block")
    out = sent.sortWithinPartitions("block").mapInArrow(reduce, schema)
    if not valued:
        return out.select(F.col("code").alias(key), "n")
    some = F.col("m") > 0
    return out.select(
        F.col("code").alias(key),
        "n",
        F.col("m").alias("n_values"),
        F.when(some, F.col("s")).alias("sum"),
        F.when(some, F.col("lo")).alias("min"),
        F.when(some, F.col("hi")).alias("max"),
    )


def _place(keys: np.ndarray, reducers: int) -> np.ndarray:
    """Blocks of a dictionary's keys by a multiplicative hash; several blocks a reducer keep each small."""
    h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (h % np.uint64(reducers * 8)).astype(np.int64)


def heavy_keys(counts: DataFrame, key: str, share: Fraction) -> DataFrame:
    """``key`` of the per-key ``counts`` (key, n; cut, as they are read twice) that hold at least ``share``
    of all rows, compared in integers."""
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total), F.col("n") * share.denominator >= F.col("_total") * share.numerator).select(key)
