"""Mixing sources to target shares of the tokens.

The documents of a source stand in a seeded order, one after the other on a line of tokens that is cut into
blocks of equal length. Sainte-Laguë apportionment gives each source its number of blocks, in all and shard
by shard; the source then gives that many blocks of its line, pass after pass, so a small source is
repeated at most ``max_repeats`` times. As the order is seeded, the blocks taken are a seeded random
choice among the source's blocks, without a second permutation. Whole documents are used: the one that would
reach past the last block is left out, and short ones that follow fill its place.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.safety import source_name
from vertexloom.session import stored

BLOCK_TOKENS = 1024
SHARDS = 8
SEED = 42
#: Documents of one bucket of the prefix sum.
BUCKET_DOCS = 20_000
#: Share of the available tokens that the default total has at least.
LEAST_FILL = 0.1
#: A target table is small by nature; more sources than this raise.
MAX_SOURCES = 10_000


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotient weight / (2 n + 1), at most ``caps`` each; ties go to the earlier one.

    Most seats follow from one divisor found by bisection, the last few one by one, so the cost doesn't
    depend on the number of seats.
    """
    caps = [c if w > 0 else 0 for c, w in zip(caps, weights)]
    seats = min(seats, sum(caps))
    count = lambda d: [min(c, int(w / d + 0.5)) if w > 0 else 0 for w, c in zip(weights, caps)]
    got = [0] * len(weights)
    if seats > len(weights):
        low, high = min(w for w in weights if w > 0) / (4 * seats), 2 * sum(weights)
        for _ in range(200):
            mid = (low * high) ** 0.5
            if sum(count(mid)) > seats - len(weights):
                low = mid
            else:
                high = mid
        got = count(high)
    queue = [(-w / (2 * n + 1), i) for i, (w, n, c) in enumerate(zip(weights, got, caps)) if n < c]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * got[i] + 1), i))
    return got


@dataclass(frozen=True)
class Mixture:
    """``rows``: doc_id, source, copy, shard, block, n_tokens, one for each time a document is used.
    block is the place on the source's line of tokens, all passes, by which a shard is given.
    ``shares``: one row for each target: what was asked for, what there was, and what was reached."""

    rows: DataFrame
    shares: DataFrame


def mix(
    sizes: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    shards: int = SHARDS,
    seed: int = SEED,
    least_fill: float = LEAST_FILL,
    bucket_docs: int = BUCKET_DOCS,
) -> Mixture:
    """Mix documents (``doc_id, source, n_tokens``) to ``targets`` (``source, target_share, max_repeats``).

    Sources are matched by ``source_name``. Documents without tokens, without a source or of a source
    without a target take no part; a target without documents gets nothing, and the other shares keep
    their proportions. Targets with a null or non-positive share or no repeats get nothing; of several
    targets of one name the shares add up and the greatest repeats count.

    ``total_tokens`` None means the largest mixture in which no present source would need more than its
    ``max_repeats`` passes, so every present source reaches its share, but at least ``least_fill`` of the
    tokens there are. With a number, or where ``least_fill`` binds, a source that would pass its cap stops
    there, and the others take the rest by quotient. ``shares`` tells which sources stopped (``capped``) and
    which one the default total hangs on (``binding``).

    A source that isn't capped gets its blocks' tokens up to less than one block, as long as its last pass has
    documents no longer than a block to fill up with. The driver holds one row a target. A source is never one
    task: its documents are cut into buckets by a hash, and places follow from prefix sums within and over the
    buckets. All places are sums of tokens, so nothing overflows below 2**63 tokens.
    """
    spark = sizes.sparkSession
    wanted = (
        targets.select(source_name().alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("t"), F.coalesce("max_repeats", F.lit(0)).alias("r"))
        .where("source IS NOT NULL")
        .groupBy("source")
        .agg(F.sum("t").alias("target_share"), F.max("r").alias("max_repeats"))
    )
    rows = sorted(wanted.limit(MAX_SOURCES + 1).collect(), key=lambda r: r.source)
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    names = spark.createDataFrame([(r.source,) for r in rows], "source string")
    docs = sizes.select("doc_id", source_name().alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).where("n_tokens > 0").join(F.broadcast(names), "source")

    # Places: tokens before a document in its source's order, of all documents and of those no longer than a block.
    stats = {r.source: (r.tokens, r.n) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    buckets = max(1, -(-sum(n for _, n in stats.values()) // bucket_docs))
    h = F.xxhash64(F.lit(seed), "doc_id")
    d = docs.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets))).withColumn("few", F.when(F.col("n_tokens") <= block_tokens, F.col("n_tokens")).otherwise(0))
    sums = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"), F.sum("few").alias("f"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "bucket", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("b"), F.coalesce(F.sum("f").over(over), F.lit(0)).alias("bf"))
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    places = d.join(before, ["source", "bucket"]).select(
        "doc_id", "source", "n_tokens", (F.col("b") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).alias("start"), (F.col("bf") + F.coalesce(F.sum("few").over(w), F.lit(0))).alias("few_before")
    )
    placed = stored(places)

    there = [stats.get(r.source, (0, 0))[0] for r in rows]
    usable = [max(0.0, r.target_share) if t and r.max_repeats > 0 else 0.0 for r, t in zip(rows, there)]
    repeats = [max(0, r.max_repeats) for r in rows]
    caps = [-(-t * r // block_tokens) for t, r in zip(there, repeats)]
    binding = None
    if total_tokens is None:
        whole = sum(usable)
        fits = {i: t * r / (u / whole) for i, (t, r, u) in enumerate(zip(there, repeats, usable)) if u > 0}
        binding = min(fits, key=fits.get) if fits else None
        total_tokens = max(int(min(fits.values(), default=0)), int(least_fill * sum(t for t, u in zip(there, usable) if u > 0)))
    seats = total_tokens // block_tokens
    upto = [[0] * len(rows)] + [sainte_lague(usable, caps, seats * k // shards) for k in range(1, shards + 1)]
    got = upto[shards]
    quota = [min(q * block_tokens, t * r) for q, t, r in zip(got, there, repeats)]

    # The last pass of each source: what fits whole, and the short documents there are up to that place.
    plan = [(r.source, t, q // t if t else 0, q % t if t else 0, [upto[k][i] for k in range(1, shards)]) for i, (r, t, q) in enumerate(zip(rows, there, quota))]
    plan_df = spark.createDataFrame(plan, "source string, pass_tokens long, passes long, rest long, bounds array<long>")
    j = placed.join(F.broadcast(plan_df), "source").withColumn("fits", F.col("start") + F.col("n_tokens") <= F.col("rest"))
    few_end = F.col("few_before") + F.when(F.col("n_tokens") <= block_tokens, F.col("n_tokens")).otherwise(0)
    last = {r.source: (r.filled, r.few) for r in j.where("fits").groupBy("source").agg(F.max(F.col("start") + F.col("n_tokens")).alias("filled"), F.max(few_end).alias("few")).collect()}
    fill = spark.createDataFrame([(x[0], *last.get(x[0], (0, 0))) for x in plan], "source string, filled long, few long")
    # A short document behind the one that didn't fit is used while the short ones up to it fill the gap.
    j = j.join(F.broadcast(fill), "source").withColumn("late", F.col("filled") + F.col("few_before") - F.col("few"))
    tops_up = ~F.col("fits") & (F.col("n_tokens") <= block_tokens) & (F.col("few_before") >= F.col("few")) & (F.col("late") + F.col("n_tokens") <= F.col("rest"))
    n = F.col("passes") + F.when(F.col("fits") | tops_up, 1).otherwise(0)
    used = j.withColumn("late", F.when(tops_up, F.col("late")).otherwise(F.col("start"))).withColumn("_n", n).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    at = (F.col("copy") - 1) * F.col("pass_tokens") + F.when(F.col("copy") > F.col("passes"), F.col("late")).otherwise(F.col("start"))
    out = used.withColumn("block", at).withColumn("block", F.expr(f"block div {block_tokens}")).select(
        "doc_id", "source", "copy", F.size(F.filter("bounds", lambda b: b <= F.col("block"))).alias("shard"), "block", "n_tokens"
    )
    reached = out.groupBy("source").agg(F.sum("n_tokens").alias("mixture_tokens"), F.max("copy").alias("repeats"))
    asked = spark.createDataFrame(
        [(r.source, float(r.target_share), int(r.max_repeats), stats.get(r.source, (0, 0))[1], t, g, g > 0 and g == c, i == binding) for i, (r, t, g, c) in enumerate(zip(rows, there, got, caps))],
        "source string, target_share double, max_repeats int, n_documents long, available_tokens long, quota_blocks long, capped boolean, binding boolean",
    )
    whole = reached.agg(F.sum("mixture_tokens").alias("_all"))
    shares = (
        asked.join(reached, "source", "left")
        .join(F.broadcast(whole))
        .select(
            *asked.columns,
            F.coalesce("mixture_tokens", F.lit(0)).cast("bigint").alias("mixture_tokens"),
            F.coalesce("repeats", F.lit(0)).alias("repeats"),
            F.coalesce(F.col("mixture_tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"),
        )
    )
    return Mixture(out, shares)
