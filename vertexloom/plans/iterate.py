"""Loops over the operators: a fixed number of pull steps, and push/pull to a fixpoint."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.message import EdgeIndex, apply_step, combine, row_bytes
from vertexloom.operators.skew import BROADCAST_BYTES
from vertexloom.session import carried, discard, fixed_plans, stored

#: A frontier, or the vertices it may improve, of at most so many (counted) rows is broadcast.
FRONTIER_ROWS = 1_000_000
#: A state that may be broadcast is written each so many rounds, and kept in memory between.
CUT_ROUNDS = 3
#: Changes are kept as tables beside the state; so many of them, or so large a share of nv, are merged into it.
DELTAS = 12
DELTA_SHARE = 4
#: Ranges of ids whose activity a round reports, as bits of longs, and ranges a pushed filter has at most.
WORDS, WORD_BITS = 8, 63
MAX_SPANS = 32


@dataclass
class Trace:
    """One row for each round: how many vertices changed, in which direction it ran, and its seconds. With
    ``bounds`` (part, row_left, row_right) also one row for each round and part."""

    bounds: DataFrame | None = None
    rows: list[tuple[int, int, str, float]] = field(default_factory=list)
    part_rows: list[tuple[int, int, int, int, str, float]] = field(default_factory=list)

    def ranges(self) -> list[tuple[int, int]]:
        """(row_left, row_right) of the parts; one row a part, so few."""
        return [(r.row_left, r.row_right) for r in self.bounds.orderBy("part").collect()] if self.bounds is not None else []

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "iter int, active bigint, mode string, seconds double")

    def part_frame(self, spark) -> DataFrame:
        """``iter, part, row_left, active, mode, seconds``; the seconds are those of the round, as its parts run at once."""
        return spark.createDataFrame(self.part_rows, "iter int, part int, row_left bigint, active bigint, mode string, seconds double")


def pull_iterate(g: Graph, state: DataFrame, message: Column, how: str, apply: dict[str, Column], n: int, every: int = 1) -> DataFrame:
    """``n`` synchronous pull steps.

    ``state`` has id and value columns of fixed width; ``message`` is an expression over the source's
    columns (and weight), combined by ``how`` (sum, min, max) per target as ``msg`` (null where no
    in-edge); ``apply`` gives the new columns from the old ones and msg; columns not named stay.
    A state beyond what may be broadcast is written each ``every`` steps and at the end (one step alone stays
    lazy), and the one before deleted; planning a chain of unwritten steps costs more than writing. A smaller one
    is written each third step. Everything compiles through Catalyst.
    """
    if n < 1:
        raise ValueError("the number of iterations must be positive")
    cols = [c for c in state.columns if c != "id"]
    if n > 1 and every == 1 and g.nv * row_bytes(len(cols)) <= BROADCAST_BYTES:
        return _pull_small(g, state, message, how, apply, n, cols)
    index = EdgeIndex(g, len(cols), keep=n > 1)
    held = cols
    if not index.small and n > 1:
        state, held = index.mark_sources(state), [*cols, "_source"]
    last = None
    for k in range(1, n + 1):
        read = state.where("_source").drop("_source") if len(held) > len(cols) else state
        sent = index.gather(read).select(F.col("dst").alias("id"), message.alias("msg"))
        both = apply_step(state, sent, how, held)
        state = both.select("id", *[apply.get(c, F.col(c)).alias(c) for c in held])
        if k % every == 0 or (k == n and n > 1):
            state = stored(state if k < n else state.select("id", *cols))
            discard(last)
            last = state
    index.release()
    return state


def _pull_small(g: Graph, state: DataFrame, message: Column, how: str, apply: dict[str, Column], n: int, cols: list[str]) -> DataFrame:
    """The steps over a state that may be broadcast: a step is a broadcast join and one exchange; it is kept in
    memory, each CUT_ROUNDS-th is written, which runs the steps up to it."""
    own = fixed_plans(g.spark, g.nv * row_bytes(len(cols)))
    edges, laid = carried(g.edges, own)
    edges = edges.persist()
    state, last = carried(state, own)
    kept: list[DataFrame] = []
    for k in range(1, n + 1):
        sent = edges.join(F.broadcast(state.withColumnRenamed("id", "_id")), F.col("src") == F.col("_id")).select(F.col("dst").alias("id"), message.alias("msg"))
        state = apply_step(state, sent, how, cols).select("id", *[apply.get(c, F.col(c)).alias(c) for c in cols])
        if k % CUT_ROUNDS and k < n:
            state = state.persist()
            kept.append(state)
        else:
            state = stored(state)
            discard(last)
            last = state
            for x in kept:
                x.unpersist()
            kept = []
    edges.unpersist()
    discard(laid)
    return g.spark.read.schema(state.schema).parquet(state._stored_at)


def push_iterate(
    g: Graph,
    state: DataFrame,
    message: Column,
    how: str,
    active: int,
    frontier: Column | None = None,
    mode: str = "auto",
    trace: Trace | None = None,
    max_rounds: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rounds of ``label' = how(label, messages)`` until none changes; ``how`` is min or max.

    ``state`` is (id, label); ``message`` an expression over the source's label; ``active`` the size of
    the first frontier and ``frontier`` the condition that picks it (None: all vertices). With mode auto
    a round pulls over all edges when more than nv // 16 vertices are active (strictly), else it pushes
    from the frontier only. The result is the same either way.

    While nv states fit ``broadcast_bytes`` a round joins the edges with the broadcast states of all vertices
    or of the frontier and aggregates once. Beyond, a push round costs what its frontier does: it reads the
    edges of active ranges of ids and looks up, and writes, only states that may change. A round is one job,
    which also counts the next frontier; tables of past rounds are deleted.
    """
    if how not in ("min", "max"):
        raise ValueError("how must be min or max")
    if mode not in ("auto", "push", "pull"):
        raise ValueError("mode must be auto, push or pull")
    best = F.least if how == "min" else F.greatest
    pick = F.min if how == "min" else F.max
    parts = trace.ranges() if trace is not None else []
    metrics = {"n": F.count_if("moved")} | {f"p{i}": F.count_if(F.col("moved") & F.col("id").between(a, b)) for i, (a, b) in enumerate(parts)}
    run = _small if g.nv * row_bytes(1) <= broadcast_bytes else _large
    rounds = run(g, state, frontier, message, how, best, pick, mode, active, metrics, max_rounds, broadcast_bytes)
    began = time.time()
    for k, (pull, got, state) in enumerate(rounds):
        if trace is not None:
            took, way = time.time() - began, "pull" if pull else "push"
            trace.rows.append((k, got["n"] or 0, way, took))
            trace.part_rows += [(k, i, a, got[f"p{i}"] or 0, way, took) for i, (a, _) in enumerate(parts)]
        began = time.time()
    return state


def _improved(both: DataFrame, best) -> DataFrame:
    moved = F.coalesce(best("label", "msg") != F.col("label"), F.lit(False))
    return both.select("id", best("label", "msg").alias("label"), moved.alias("moved"))


def _small(g, state, frontier, message, how, best, pick, mode, active, metrics, max_rounds, broadcast_bytes):
    """Rounds over a state that may be broadcast: the state of a round is one union and aggregation.

    Its plans are fixed (a broadcast join, one exchange), so they run in a session of the same application
    without adaptive planning and with few partitions; a round is kept in memory and counted by one job, each
    CUT_ROUNDS-th is written.
    """
    own = fixed_plans(g.spark, g.nv * row_bytes(1))
    edges, laid = carried(g.edges, own)
    edges = edges.persist()
    state, last = carried(state, own)
    kept = []
    front = state if frontier is None else state.where(frontier)
    k = 0
    while max_rounds is None or k < max_rounds:
        pull = mode == "pull" or (mode == "auto" and active > g.nv // 16)
        s = (state if pull else front).withColumnRenamed("id", "_id")
        sent = edges.join(F.broadcast(s), F.col("src") == F.col("_id")).select(F.col("dst").alias("id"), message.alias("msg"))
        new = _improved(apply_step(state, sent, how, ["label"], pick), best)
        if (k + 1) % CUT_ROUNDS:
            new = new.persist()
            kept.append(new)
            got = new.agg(*[c.alias(n) for n, c in metrics.items()]).first().asDict()
        else:
            seen = Observation()
            new = stored(new, seen, **metrics)
            got = seen.get
            discard(last)
            last = new
            for x in kept:
                x.unpersist()
            kept = []
        active = got["n"] or 0
        state, front = new.select("id", "label"), new.where("moved").select("id", "label")
        k += 1
        done = not active or k == max_rounds
        if done:
            out = stored(state) if kept else new
            for x in [*kept, edges]:
                x.unpersist()
            discard(laid, last if kept else None)
            yield pull, got, g.spark.read.schema(out.schema).parquet(out._stored_at).select("id", "label")
            return
        yield pull, got, state


def _large(g, state, frontier, message, how, best, pick, mode, active, metrics, max_rounds, broadcast_bytes):
    """Rounds over a state that is too large to be broadcast.

    A pull round writes the state anew. A push round reads the edges of the ranges of ids that hold active
    vertices, looks up the state of the vertices that got a message, without moving it, and writes the
    changed rows alone, as a table beside the state; now and then these tables are merged into it.
    """
    marks = _Marks(g.nv)
    metrics = metrics | marks.metrics(F.col("moved"))
    index = EdgeIndex(g, broadcast_bytes=broadcast_bytes, keep=True, by_source=mode != "pull")
    base, deltas, pending = state, [], 0
    front, within = (state, None) if frontier is None else (state.where(frontier), None)
    if frontier is not None and mode != "pull":
        within = marks.within(front.agg(*[c.alias(n) for n, c in marks.metrics(F.lit(True)).items()]).first().asDict())
    k = 0
    while max_rounds is None or k < max_rounds:
        seen, rest = Observation(), []
        pull = mode == "pull" or (mode == "auto" and active > g.nv // 16)
        known = reduce(DataFrame.unionByName, deltas, base)
        if pull or active > FRONTIER_ROWS:
            now = _merged(known, pick) if deltas else base
            sent = index.gather(now if pull else front).select(F.col("dst").alias("id"), message.alias("msg"))
            both = apply_step(known, sent, how, ["label"], pick)
        else:
            counted = Observation()
            sent = index.scatter(front, within).select(F.col("dst").alias("id"), message.alias("msg"))
            wanted = stored(combine(sent, how, key="id"), counted, n=F.count("*"))
            rest.append(wanted)
            if (counted.get["n"] or 0) <= FRONTIER_ROWS:
                both = known.join(F.broadcast(wanted), "id").groupBy("id").agg(pick("label").alias("label"), F.first("msg").alias("msg"))
            else:
                both = apply_step(known, wanted, how, ["label"], pick)
        new = _improved(both, best)
        new = stored(new if pull else new.where("moved"), seen, **metrics)
        got = seen.get
        active, within = got["n"] or 0, marks.within(got)
        discard(*rest)
        if pull:
            discard(base, *deltas)
            base, deltas, pending = _keep(new), [], 0
        elif active:
            deltas, pending = [*deltas, _keep(new)], pending + active
        else:
            discard(new)
        front = new.where("moved").select("id", "label")
        k += 1
        if not active or k == max_rounds:
            if deltas:
                base = _fold(base, deltas, pick, [])
            index.release()
            yield pull, got, base
            return
        yield pull, got, base
        if len(deltas) >= DELTAS or pending * DELTA_SHARE > g.nv:
            base, deltas, pending = _fold(base, deltas, pick, deltas[-1:]), deltas[-1:], 0


def _keep(new: DataFrame) -> DataFrame:
    out = new.select("id", "label")
    out._stored_at = new._stored_at
    return out


def _merged(known: DataFrame, pick) -> DataFrame:
    """One row per id: labels only ever get better, so the best of the state and its changes is the present one."""
    return known.groupBy("id").agg(pick("label").alias("label"))


def _fold(base: DataFrame, deltas: list[DataFrame], pick, leave: list[DataFrame]) -> DataFrame:
    """The state with all changes; those in ``leave`` are still read and stay."""
    out = stored(_merged(reduce(DataFrame.unionByName, deltas, base), pick))
    discard(base, *[d for d in deltas if not any(d is x for x in leave)])
    return out


class _Marks:
    """Which of WORDS * WORD_BITS equal ranges of ids hold a changed vertex, as a few longs that a round's job reports."""

    def __init__(self, nv: int):
        self.size = max(1, -(-nv // (WORDS * WORD_BITS)))
        self.nv = nv

    def metrics(self, moved: Column) -> dict[str, Column]:
        r = F.expr(f"id div {self.size}")
        bit = lambda w: F.expr(f"shiftleft(1L, CAST((id div {self.size}) - {w * WORD_BITS} AS INT))")
        return {f"w{w}": F.bit_or(F.when(moved & r.between(w * WORD_BITS, (w + 1) * WORD_BITS - 1), bit(w))) for w in range(WORDS)}

    def within(self, got: dict) -> Column | None:
        """A condition on src that every changed vertex meets; None where it would spare little."""
        on = [w * WORD_BITS + b for w in range(WORDS) for b in range(WORD_BITS) if ((got.get(f"w{w}") or 0) >> b) & 1]
        spans: list[list[int]] = []
        for r in on:
            if spans and spans[-1][1] == r:
                spans[-1][1] = r + 1
            else:
                spans.append([r, r + 1])
        if len(spans) > MAX_SPANS or len(on) * 2 * self.size > self.nv:
            return None
        conds = [(F.col("src") >= a * self.size) & (F.col("src") < b * self.size) for a, b in spans]
        return reduce(lambda x, y: x | y, conds) if conds else None
