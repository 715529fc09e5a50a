"""Connected groups of pairwise matches by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from vertexloom.operators.skew import ROWS_PER_TASK
from vertexloom.session import discard, stored

#: Rounds shrink the longest path by a constant factor; this many would join 2**100 records.
MAX_ROUNDS = 200


def _lightest(links: DataFrame, u: str, v: str, rows_per_task: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """``links`` with ``c``, the least ``v`` of their ``u``, and the tables to delete once the result is written.

    One exchange by ``u`` and a window; repeated links drop out on the way. The links of a record with more
    than ``rows_per_task`` (``most`` is the largest number a record has) don't gather: its least is found by a
    map-side combined aggregate and goes to them, as at most links / rows_per_task records can have so many.
    """
    w = Window.partitionBy(u).orderBy(v)
    first = lambda df: df.withColumn("c", F.first(v).over(w)).withColumn("_p", F.lag(v).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(v))).drop("_p")
    if most <= rows_per_task:
        return first(links), []
    hot = stored(links.groupBy(u).agg(F.count("*").alias("_n"), F.min(v).alias("c")).where(F.col("_n") > rows_per_task).select(F.col(u).alias("_h"), "c"))
    few = F.broadcast(hot)
    spread = links.join(few, F.col(u) == F.col("_h")).drop("_h").distinct()
    rest = first(links.join(few, F.col(u) == F.col("_h"), "left_anti"))
    return rest.unionByName(spread), [hot]


def connect(pairs: DataFrame, src: str = "src", dst: str = "dst", label: str = "min", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``id, label`` of every record in at least one pair: the least (or with ``label="max"`` the greatest)
    id of all records linked to it directly or over others.

    Pairs have no direction; repeated pairs don't matter, a self-pair only makes its record known. Pairs
    with a null end take no part. No pairs give no rows.

    Large-star links every larger neighbour of a record to its smallest neighbour, small-star every smaller
    one and itself. A round is one job of two exchanges, one for each star, that writes the links once; the
    links of the round before are then deleted. The links are done when a round rewrites none, which the same
    job counts. What a record's degree has become is counted before, so that one with very many links is
    spread.
    """
    if label not in ("min", "max"):
        raise ValueError("label must be min or max")
    sign = 1 if label == "min" else -1
    p = pairs.select((F.col(src).cast("bigint") * sign).alias("a"), (F.col(dst).cast("bigint") * sign).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    # A self-pair stays as a link of a record with itself until the end: it joins no other records.
    counted = Observation()
    edges = stored(p.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), counted, n=F.count_if(F.col("u") > F.col("v")))
    n_links = counted.get["n"] or 0
    alone = edges.where("u = v").select("u")
    now = edges.where("u > v")
    last = None
    for _ in range(MAX_ROUNDS):
        if not n_links:
            break
        most = n_links  # no record has more; counted where that doesn't settle whether one is hot
        if most > rows_per_task:
            ends = now.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
            most = ends.agg(F.max("n")).first()[0]
        seen, seen_large = Observation(), Observation()
        both = now.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least, tables = _lightest(both, "u", "v", rows_per_task, most)
        # Large-star: links to larger neighbours go to the least of the record and its neighbours.
        large = least.where("v > u").select(F.col("v").alias("u"), F.least("u", "c").alias("v"), (F.col("c") < F.col("u")).alias("moved"))
        if tables:  # hot records: the rewritten links are read more than once
            large = stored(large)
            tables.append(large)
        large = large.observe(seen_large, F.count_if("moved").alias("n")).select("u", "v")
        # Small-star: a record's smaller neighbours, and itself, go to the least of them. It has no more of them than before.
        small, more = _lightest(large, "u", "v", rows_per_task, most)
        # Of a record's rows one holds that least itself: it becomes the record's own link, each other its neighbour's.
        out = small.select(F.when(F.col("v") == F.col("c"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("c").alias("v"), (F.col("v") != F.col("c")).alias("moved"))
        new = stored(out, seen, n=F.count_if("moved"), rows=F.count("*"))
        n_links = seen.get["rows"]
        moved = (seen.get["n"] or 0) + (seen_large.get["n"] or 0)
        discard(last, *tables, *more)
        last, now = new, new.select("u", "v")
        if not moved:
            break
    else:
        raise RuntimeError(f"not connected after {MAX_ROUNDS} rounds")
    # Each record is in one star: its links name its centre, and a centre's own name is the v of a link.
    named = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("v").alias("v")))).alias("e")).select("e.u", "e.v")
    found = named.unionByName(alone.select("u", F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("v"))
    return found.select((F.col("u") * sign).alias("id"), (F.col("v") * sign).alias("label"))
