"""The N highest-scoring items of every group, by skipping what the statistics rule out.

Rows are clustered by group into Parquet files, within a file by (group, score descending, item), in row
groups of few rows, so a group larger than a row group fills row groups of its own with falling maximum
scores. A task reads the row groups of a file in descending order of maximum score and skips each whose
maximum is strictly below the N-th score that every group it contains has by then: of a group with millions
of items little more than N are read. A row group in which a group begins holds that group's best rows, so
it is always read; what is skipped are the rows behind the first few of each group of several row groups.
"""

from __future__ import annotations

from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from vertexloom.operators.skew import salted
from vertexloom.session import discard, remove, scratch, ship, stored
from vertexloom.sources.paths import arrow_file

#: Rows of one file, and the rows from which a group is spread over several.
ROWS_PER_FILE = 1_000_000
#: Rows of a row group: the grain of what is skipped.
ROWS_PER_GROUP = 2_048
#: Rows from which a file is made for each shuffle partition.
SPREAD_ROWS = 100_000


def _best(group: np.ndarray, item: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` distinct items of each group by (score descending, item)."""
    order = np.lexsort((item, -score, group))
    g, i = group[order], item[order]
    again = np.lexsort((np.arange(len(g)), i, g))  # an item's best row comes first among its rows
    first = np.ones(len(g), bool)
    first[1:] = (g[again][1:] != g[again][:-1]) | (i[again][1:] != i[again][:-1])
    keep = np.zeros(len(g), bool)
    keep[again[first]] = True
    order, g = order[keep], g[keep]
    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(g)]])))
    return order[rank < n]


def read_file(source, n: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int, int]:
    """The best rows of every group in an open file as arrays, and the numbers of row groups read and there."""
    import pyarrow.parquet as pq

    out, state, read = [], {}, 0
    with pq.ParquetFile(source) as f:
        meta = f.metadata
        stats = []
        for r in range(meta.num_row_groups):
            g, s = meta.row_group(r).column(0).statistics, meta.row_group(r).column(2).statistics
            stats.append((s.max, g.min, g.max))
        for r in sorted(range(len(stats)), key=lambda r: (-stats[r][0], r)):
            top, low, high = stats[r]
            if low == high and low in state and len(state[low][0]) >= n and top < state[low][0][-1]:
                continue
            read += 1
            t = f.read_row_group(r)
            group, item, score = (t.column(c).to_numpy() for c in range(3))
            at = _best(group, item, score, n)
            group, item, score = group[at], item[at], score[at]
            # Files are sorted by group, so only the groups at both ends can go on in a neighbour.
            open_ends = {e for e, other in ((low, r - 1), (high, r + 1)) if 0 <= other < len(stats) and stats[other][1] <= e <= stats[other][2]}
            for e in open_ends:
                a, b = np.searchsorted(group, [e, e + 1])
                s, i = score[a:b], item[a:b]
                if e in state:
                    s, i = np.concatenate([state[e][0], s]), np.concatenate([state[e][1], i])
                    k = _best(np.zeros(len(s), np.int64), i, s, n)
                    s, i = s[k], i[k]
                state[e] = (s, i)
            if open_ends:
                whole = ~np.isin(group, list(open_ends))
                group, item, score = group[whole], item[whole], score[whole]
            out.append((group, item, score))
    for e, (s, i) in state.items():
        out.append((np.full(len(s), e), i, s))
    return out, read, len(stats)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5, rows_per_file: int = ROWS_PER_FILE, rows_per_group: int = ROWS_PER_GROUP) -> tuple[DataFrame, DataFrame]:
    """(``group, item, score, rank``; ``row_groups_read, row_groups, n_files``).

    group and item are integers, the score any number. Of an item that occurs several times in a group the
    greatest score counts; ties go to the smaller item. Rows with a null group, item or score, or a NaN
    score, take no part. A group with fewer than ``n`` items gives all of them. An empty frame gives no rows.

    A group with more than ``rows_per_file`` rows is spread over several files by the hash of the item
    (so all rows of an item stay together); only such groups need a second, small step: n rows a file.
    The clustered table lies in the shared folder until the result, written too, has been made of it. Tasks
    open its files themselves; where the Arrow library doesn't know the file system, Spark hands them over
    whole and only the decoding is skipped.
    """
    if n < 1:
        raise ValueError("n must be positive")
    spark = df.sparkSession
    ship(spark)
    kind = dict(df.dtypes)[score]
    wide = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "double"
    src = df.select(F.col(group).cast("bigint").alias("g"), F.col(item).cast("bigint").alias("i"), F.col(score).cast(wide).alias("s"))
    src = src.where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL" + (" AND NOT isnan(s)" if wide == "double" else ""))
    seen, hots = Observation(), Observation()
    src = stored(src, seen, n=F.count("*"))
    rows = seen.get["n"] or 0
    sizes = src.groupBy("g").agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_file)
    hot = stored(sizes.select("g", F.ceil(F.col("_n") / rows_per_file).cast("int").alias("n_salts")), hots, n=F.count("*"))
    n_hot = hots.get["n"] or 0  # at most rows / rows_per_file
    files = max(1, -(-rows // rows_per_file), int(spark.conf.get("spark.sql.shuffle.partitions")) if rows > SPREAD_ROWS else 1)
    path = scratch(spark, "topn")
    spread = salted(src, "g", "i", hot) if n_hot else src.withColumn("_salt", F.lit(0))
    laid = spread.repartition(files, "g", "_salt").sortWithinPartitions("g", F.col("s").desc(), "i").select("g", "i", "s")
    laid.write.option("parquet.block.row.count.limit", rows_per_group).parquet(path)
    discard(src)
    names = [unquote(x) for x in spark.read.schema(f"g bigint, i bigint, s {wide}").parquet(path).inputFiles()] if rows else []
    schema = f"g bigint, i bigint, s {wide}, rank int, read int, there int"
    columns = ["g", "i", "s", "rank", "read", "there"]
    s_type = pa.int64() if wide == "bigint" else pa.float64()

    def run(opened):
        def over(batches):
            for b in batches:
                for x in b.column(0).to_pylist():
                    parts, read, there = read_file(opened(x), n)
                    g, i, s = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(3))
                    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
                    rank = np.arange(1, len(g) + 1) - np.repeat(begins, np.diff(np.concatenate([begins, [len(g)]])))
                    z, one = pa.nulls(len(g), pa.int32()), pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(i, pa.int64()), pa.array(s, s_type), pa.array(rank, pa.int32()), z, z], names=columns)
                    yield pa.RecordBatch.from_arrays([one, one, pa.nulls(1, s_type), pa.nulls(1, pa.int32()), pa.array([read], pa.int32()), pa.array([there], pa.int32())], names=columns)

        return over

    if not names:
        got = spark.createDataFrame([], schema)
    elif _opens(names[0]):
        listed = spark.createDataFrame([(k, x) for k, x in enumerate(names)], "k int, f string")
        got = stored(listed.repartitionByRange(min(len(names), 4 * files), "k").select("f").mapInArrow(run(arrow_file), schema))
    else:
        whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("content")
        got = stored(whole.mapInArrow(run(pa.BufferReader), schema))
    remove(spark, path)
    found = got.where("g IS NOT NULL").select("g", "i", "s", "rank")
    w = Window.partitionBy("g").orderBy(F.col("s").desc(), "i")
    if n_hot:  # n rows a file of the spread groups, and of these alone, meet once more
        few = F.broadcast(hot.select("g"))
        again = found.join(few, "g", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        ranked = found.join(few, "g", "left_anti").unionByName(again)
    else:
        ranked = found  # a file holds whole groups
    result = ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").cast(kind).alias(score), "rank")
    report = got.where("g IS NULL").agg(F.sum("read").alias("row_groups_read"), F.sum("there").alias("row_groups"), F.count("*").alias("n_files"))
    return result, report


def _opens(name: str) -> bool:
    try:
        arrow_file(name).close()
        return True
    except OSError:
        return False
