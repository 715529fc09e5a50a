"""The k most similar vectors of every vector, by randomly rotated one-bit codes.

Vectors are assigned to clusters; the part of a vector beyond its cluster's centre is rotated at random
and kept as one sign bit a dimension plus correction scalars. For a query the inner product with each
vector of the clusters it probes is estimated from the packed bits, with a bound on the error; only the
vectors whose bound says they may be among the best are compared exactly.

Neighbouring clusters form bundles, the units of work: a query goes to each bundle it probes once, with the
list of its clusters there. A bundle's vectors travel with their codes, as a few dozen dimensions weigh less
than fetching the survivors of the bounds again by two joins would.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from vertexloom.session import discard, ship, stored

#: Vectors the clusters are fitted on, at most (a documented sample; every vector is indexed), and clusters at most.
SAMPLE = 262_144
MAX_CLUSTERS = 65_536
#: Clusters from which they are fitted in two levels, and vectors fitted on for each cluster.
FLAT_CLUSTERS = 1_024
PER_CLUSTER = 64
#: Clusters a query looks into: so many times the square root of their number, at least so many.
PROBES, LEAST_PROBES = 2.0, 32
#: Bits of a code, a multiple of 64; vectors of fewer dimensions are rotated into so many.
BITS = 64
#: Multiple of the standard error within which an estimate is trusted.
EPSILON = 1.9
#: Bits to which a query's rotated items are rounded.
QUERY_BITS = 4
#: Vectors and queries of one unit of work, at most, and estimates held at a time.
BASE_ROWS = 65_536
QUERY_ROWS = 131_072
TILE = 4_000_000
#: Tasks over which the members of a group of equal vectors are spread.
COPY_SALTS = 32


def usable(v: str | Column, dims: int) -> Column:
    """Exactly ``dims`` items, none null, NaN or infinite, not all zero."""
    c = F.col(v) if isinstance(v, str) else v
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) == dims) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(lists: pa.Array, dims: int) -> np.ndarray:
    x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # before squaring, so that nothing over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, TILE // len(c))
    return np.concatenate([(x[i : i + step] @ c.T).argmax(axis=1) for i in range(0, len(x), step)])


def fit_clusters(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means from seeded members of the sample; many are fitted in two levels, so that the
    cost grows as k ** 1.5."""
    rng = np.random.default_rng(seed)
    if len(x) > PER_CLUSTER * k:
        x = x[rng.choice(len(x), size=PER_CLUSTER * k, replace=False)]
    if k > FLAT_CLUSTERS:
        coarse = fit_clusters(x, ceil(sqrt(k)), seed, rounds)
        cell = nearest(x, coarse)
        share = [max(1, round(k * n / len(x))) if n else 0 for n in np.bincount(cell, minlength=len(coarse))]
        return np.concatenate([fit_clusters(x[cell == i], min(m, FLAT_CLUSTERS), seed + i, rounds) for i, m in enumerate(share) if m])
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = nearest(x, c)
        sums = np.stack([np.bincount(home, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


@dataclass(frozen=True)
class Codec:
    centers: np.ndarray
    rotation: np.ndarray  # dims x bits, orthonormal rows
    seed: int

    @staticmethod
    def fit(sample: np.ndarray, k: int, bits: int, seed: int) -> "Codec":
        dims = sample.shape[1]
        bits = max(bits, -(-dims // 64) * 64)
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
        return Codec(fit_clusters(sample, k, seed), (q * np.sign(np.diag(r)))[:dims], seed)

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, length of the part beyond the centre, and its inner product with its own code."""
        rest = x - self.centers[home]
        norm = np.linalg.norm(rest, axis=1)
        turned = rest @ self.rotation
        code = np.packbits(turned >= 0, axis=1, bitorder="little")
        own = np.abs(turned).sum(axis=1) / (np.sqrt(self.bits) * np.maximum(norm, 1e-12))
        return code, norm, np.where(norm > 1e-12, own, 1.0)


def estimate(codec: Codec, cluster: int, q: np.ndarray, code: np.ndarray, norm: np.ndarray, own: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of ``q`` with the coded vectors of a cluster, and the bounds of their errors.

    ``code`` is uint64 words, ``along`` the vectors' inner products with the centre.
    """
    c, bits = codec.centers[cluster], codec.bits
    rest = q - c
    turned = rest @ codec.rotation
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-12)
    level = np.rint((turned - low) / step).astype(np.uint8)
    total = np.zeros((len(q), len(code)), np.float32)
    for b in range(QUERY_BITS):
        plane = np.packbits((level >> b) & 1, axis=1, bitorder="little").view(np.uint64)
        for w in range(code.shape[1]):
            total += np.bitwise_count(plane[:, w, None] & code[None, :, w]) * np.float32(2**b)
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.float32)
    root = np.float32(np.sqrt(bits))
    signed = (2 * step / root).astype(np.float32) * total
    signed += (2 * low / root).astype(np.float32) * ones
    signed -= (step / root * level.sum(axis=1, keepdims=True) + root * low).astype(np.float32)
    signed *= (norm / own).astype(np.float32)
    signed += along.astype(np.float32)
    signed += (q @ c - c @ c)[:, None].astype(np.float32)
    spread = norm * np.sqrt(np.maximum(1 - own**2, 0)) / own * (EPSILON / np.sqrt(bits - 1))
    # rounding the query shifts each item by at most half a step
    slack = np.linalg.norm(rest, axis=1)[:, None].astype(np.float32) * spread.astype(np.float32) + (0.5 * step).astype(np.float32) * (norm / own).astype(np.float32)
    return signed, slack


def search_block(codec: Codec, cluster: int, k: int, floor: float, base: dict, queries: dict):
    """(query id, id, similarity): up to ``k`` best of the block for each query, itself left out."""
    out = []
    ids, x = base["id"], base["x"]
    step = max(16, min(512, TILE // max(1, len(ids))))
    along = x @ codec.centers[cluster]
    code = base["code"].view(np.uint64)
    for i in range(0, len(queries["id"]), step):
        q, qid = queries["x"][i : i + step], queries["id"][i : i + step]
        est, err = estimate(codec, cluster, q, code, base["norm"], base["own"], along)
        self_row, self_col = np.nonzero(qid[:, None] == ids[None, :])
        lower = est - err
        lower[self_row, self_col] = -np.inf
        least = np.full(len(q), floor, np.float32)
        if lower.shape[1] > k:
            least = np.maximum(least, np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k])
        est += err
        est[self_row, self_col] = -np.inf
        r, c = np.nonzero(est >= least[:, None])
        if not len(r):
            continue
        sim = np.einsum("ij,ij->i", q[r], x[c])  # the exact comparison of what the bounds left
        fine = sim >= floor
        r, c, sim = r[fine], c[fine], np.round(sim[fine], 12)
        order = np.lexsort((ids[c], -sim, r))
        r, c, sim = r[order], c[order], sim[order]
        keep = _rank(r) < k
        out.append((qid[r[keep]], ids[c[keep]], sim[keep]))
    return _joined(out)


def _rank(runs: np.ndarray) -> np.ndarray:
    """Position of each item within its run of equal ones."""
    begins = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, int)
    return np.arange(len(runs)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(runs)]])))


def _joined(parts: list) -> list[np.ndarray]:
    return [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, (np.int64, np.int64, np.float64)[j]) for j in range(3)]


def search_bundle(codec: Codec, k: int, floor: float, home: np.ndarray, base: dict, queries: dict, asks: np.ndarray, cluster: np.ndarray):
    """As ``search_block`` over the clusters of a bundle: row ``asks[i]`` of the queries looks into ``cluster[i]``."""
    by_home, by_cluster = np.argsort(home, kind="stable"), np.argsort(cluster, kind="stable")
    home, asks, cluster = home[by_home], asks[by_cluster], cluster[by_cluster]
    out = []
    for c in np.unique(home):
        a, b = np.searchsorted(home, [c, c + 1])
        d, e = np.searchsorted(cluster, [c, c + 1])
        if d < e:
            rows, q = by_home[a:b], asks[d:e]
            out.append(search_block(codec, int(c), k, floor, {n: v[rows] for n, v in base.items()}, {n: v[q] for n, v in queries.items()}))
    q, other, sim = _joined(out)
    order = np.lexsort((other, -sim, q))
    order = order[_rank(q[order]) < k]
    return q[order], other[order], sim[order]


def bundles(centers: np.ndarray, size: np.ndarray, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each cluster and the hash parts of each bundle: neighbouring clusters with about ``rows`` vectors
    together; a cluster with more is a bundle of several parts."""
    cells = max(1, min(len(centers), int(size.sum() // max(1, rows))))
    cell = nearest(centers, fit_clusters(centers, cells, seed, 4))
    of, parts, held, last = np.zeros(len(centers), np.int32), [], rows + 1, -1
    for c in np.argsort(cell, kind="stable"):
        if cell[c] != last or held + size[c] > rows:
            parts.append(0)
            held = 0
        of[c], last, held = len(parts) - 1, cell[c], held + size[c]
        parts[-1] = max(1, ceil(held / max(rows, BASE_ROWS)))
    return of, np.array(parts, np.int32)


def _copies(vectors: DataFrame, k: int) -> DataFrame:
    """``key, ids, n``: each distinct vector with its k + 1 smallest ids and its number of rows.

    A vector that a third of the rows share is spread over COPY_SALTS tasks before its few smallest ids meet.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS))
    a = vectors.groupBy("key", salt.alias("s")).agg(F.count("*").alias("n"))
    counts = a.groupBy("key").agg(F.sum("n").alias("n"))
    first = vectors.withColumn("s", salt).withColumn("r", F.row_number().over(Window.partitionBy("key", "s").orderBy("id"))).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    return first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(counts, "key")


def most_similar(
    df: DataFrame,
    k: int = 5,
    dims: int = 20,
    id: str = "id",
    vector: str = "v",
    queries: Column | None = None,
    floor: float = -2.0,
    probes: int | None = None,
    clusters: int | None = None,
    bits: int = BITS,
    sample: int = SAMPLE,
    seed: int = 7,
) -> DataFrame:
    """``id, neighbor, similarity, rank``: for every row the ``k`` others with the greatest cosine.

    ``df`` has one row an id. Rows without a usable vector (see ``usable``) or with a null id neither ask
    nor answer. ``queries`` is a condition on id that picks who asks (None: all); everyone answers.
    Only neighbours with a cosine of at least ``floor`` are given; the floor is used in the search, too.
    Ties go to the smaller id. Equal directions are indexed once, and their ids put back at the end, so
    large groups of copies cost nothing. Fewer than k + 1 usable rows give what there is; none give none.

    The clusters are fitted on at most ``sample`` vectors, picked by a hash of the id; every vector is
    indexed. ``probes`` defaults to PROBES times the square root of the number of clusters. With a floor a query
    looks into every cluster that may hold a neighbour, however many: those whose centre is within the floor's
    angle plus the cluster's own radius, and whose side of the plane to the query's nearest centre is within that
    angle. Centres,
    rotation and radii (at most MAX_CLUSTERS rows) are what the driver holds and sends to the workers. A cluster
    or a set of queries that is too large for one unit is split, so memory is bounded whatever the skew.
    """
    spark = df.sparkSession
    ship(spark)
    src = df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v", dims))

    def pack(batches):
        for b in batches:
            x = unit(b.column(1), dims).astype(np.float32)
            x += np.float32(0)  # -0.0 and 0.0 are one
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(x), [None, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), raw.cast(pa.binary())], names=["id", "key"])

    vectors = stored(src.mapInArrow(pack, "id bigint, key binary"))
    seen = Observation()
    # Equal directions: counted by a map-side combined aggregate, so a vector that many rows share is no burden.
    equal = stored(vectors.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("rep")), seen, n=F.count("*"), many=F.count_if(F.col("n") > 1))
    n, copied = seen.get["n"] or 0, (seen.get["many"] or 0) > 0
    if n == 0:
        return spark.createDataFrame([], "id bigint, neighbor bigint, similarity double, rank int")
    picked = equal if n <= sample else equal.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(n)) < sample)
    rows = picked.select("key").limit(2 * sample).toArrow().column("key").to_pylist()
    x = np.frombuffer(b"".join(sorted(rows)), np.float32).reshape(-1, dims).astype(np.float64)
    clusters = clusters or min(MAX_CLUSTERS, max(1, int(2 * np.sqrt(n))), max(1, len(x) // 4))
    codec = Codec.fit(x, clusters, bits, seed)
    clusters = len(codec.centers)
    sent = spark.sparkContext.broadcast(codec)
    probes = min(clusters, probes or max(LEAST_PROBES, ceil(PROBES * sqrt(clusters))))
    vec = lambda col: np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dims).astype(np.float64)

    def assign(batches):
        c = sent.value
        for b in batches:
            v = vec(b.column(1))
            home = nearest(v, c.centers)
            code, norm, own = c.encode(v, home)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(v), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            away = np.arccos(np.clip(np.einsum("ij,ij->i", v, c.centers[home]), -1, 1))
            cols = [b.column(0), b.column(1), pa.array(home.astype(np.int32)), raw, pa.array(norm.astype(np.float32)), pa.array(own.astype(np.float32)), pa.array(away)]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "key", "home", "code", "norm", "own", "away"])

    index = stored(equal.select("rep", "key").mapInArrow(assign, "rep bigint, key binary, home int, code binary, norm float, own float, away double"))
    size, radius = np.zeros(clusters, np.int64), np.full(clusters, -np.inf)
    for r in index.groupBy("home").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect():  # a row a cluster
        size[r.home], radius[r.home] = r.n, r.far
    angle = np.arccos(floor) + 1e-6 if floor > -1 else np.inf
    # A neighbour lies within the angle of the query and is nearer to its own centre than to the query's nearest one,
    # that is on its side of the plane between the two; and no farther from its centre than the cluster's radius.
    turn = np.sin(angle) if angle < np.pi / 2 else np.inf
    reach = np.cos(np.minimum(angle + radius, np.pi)) - 1e-9 if angle < np.inf else None

    def probe(v: np.ndarray, c: Codec):
        """(row, cluster) of what the vectors look into."""
        out, step = [], max(1, TILE // clusters)
        for i in range(0, len(v), step):
            sims = v[i : i + step] @ c.centers.T
            if angle < np.inf:
                best = sims.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * (c.centers[best] @ c.centers.T), 0))
                side = sims[np.arange(len(sims)), best][:, None] - sims <= turn * apart + 1e-9
                r, k_ = np.nonzero(side & (sims >= reach))
            else:
                k_ = np.argpartition(-sims, probes - 1, axis=1)[:, :probes].ravel()
                r = np.repeat(np.arange(len(sims)), probes)
            out.append((r + i, k_))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    # Bundles, their hash parts, and, from the sample, the parts their queries are to be split into.
    asking, n_asking = index, n
    if queries is not None:  # a group asks if any of its members does
        askers = vectors.where(queries).select("key").distinct()
        asking = stored(index.join(askers, "key", "left_semi").select("rep", "key"))
        n_asking = asking.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of, parts = bundles(codec.centers, size, int(min(BASE_ROWS, max(1024, n // (2 * tasks)))), seed)
    some = x[np.random.default_rng(seed).choice(len(x), size=min(len(x), 8_192), replace=False)]
    r, c = probe(some, codec)
    pairs = np.unique(r.astype(np.int64) * len(parts) + of[c])
    load = np.bincount(pairs % len(parts), minlength=len(parts)) * (1.3 * n_asking / len(some))
    splits = np.maximum(1, np.ceil(load / QUERY_ROWS)).astype(np.int32)
    layout = spark.sparkContext.broadcast((of, parts, splits))
    units = spark.createDataFrame([(int(c), int(of[c]), int(parts[of[c]]), int(splits[of[c]])) for c in range(clusters) if size[c]], "home int, bundle int, pb int, pq int")
    base = index.join(F.broadcast(units), "home").select(
        "bundle", F.pmod(F.xxhash64("rep"), F.col("pb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("pq") - 1)).alias("q"), "rep", "key", "home", "code", "norm", "own"
    )

    def ask(batches):
        of, parts, splits = layout.value
        for b in batches:
            if not b.num_rows:
                continue
            row, cluster = probe(vec(b.column(1)), sent.value)
            order = np.lexsort((of[cluster], row))
            row, cluster = row[order], cluster[order]
            to = of[cluster]
            begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (to[1:] != to[:-1])])) if len(row) else np.zeros(0, int)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([begins, [len(row)]]), pa.int32()), pa.array(cluster, pa.int32()))
            at = pa.array(row[begins])
            cols = [pa.array(to[begins]), pa.array(parts[to[begins]]), pa.array(splits[to[begins]]), b.column(0).take(at), b.column(1).take(at), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["bundle", "pb", "pq", "asker", "asks", "clusters"])

    asked = asking.select("rep", "key").mapInArrow(ask, "bundle int, pb int, pq int, asker bigint, asks binary, clusters array<int>")
    query = asked.select(F.col("bundle").alias("to"), F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("b"), F.pmod(F.xxhash64("asker"), F.col("pq")).cast("int").alias("q"), "asker", "asks", "clusters")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        a = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)]
        if left.num_rows and right.num_rows:
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            base = {"id": left.column("rep").to_numpy(), "x": vec(left.column("key")), "code": code, "norm": left.column("norm").to_numpy().astype(np.float64), "own": left.column("own").to_numpy().astype(np.float64)}
            lists = right.column("clusters").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            asks = np.repeat(np.arange(right.num_rows), np.diff(lists.offsets.to_numpy()))
            a = search_bundle(sent.value, k, floor, left.column("home").to_numpy(), base, {"id": right.column("asker").to_numpy(), "x": vec(right.column("asks"))}, asks, lists.flatten().to_numpy())
        return pa.table({"rep": pa.array(a[0], pa.int64()), "other": pa.array(a[1], pa.int64()), "sim": pa.array(a[2], pa.float64())})

    found = base.groupBy("bundle", "b", "q").cogroup(query.groupBy("to", "b", "q")).applyInArrow(search, "rep bigint, other bigint, sim double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("sim").desc(), "other"))).where(F.col("r") <= k)
    if not copied:
        discard(vectors)
        return best.select(F.col("rep").alias("id"), F.col("other").alias("neighbor"), F.col("sim").alias("similarity"), F.col("r").alias("rank"))
    # Back to rows: the ids of the other groups, and of the own one at similarity 1.
    groups = stored(_copies(vectors, k).withColumn("rep", F.col("ids")[0]))
    others = best.join(groups.select(F.col("rep").alias("other"), "ids"), "other").select("rep", F.explode("ids").alias("neighbor"), "sim")
    own = groups.where(F.col("n") > 1).select("rep", F.explode("ids").alias("neighbor"), F.lit(1.0).alias("sim"))
    if queries is not None:
        own = own.join(asking.select("rep"), "rep", "left_semi")
    ranked = others.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("sim").desc(), "neighbor"))).where(F.col("r") <= k + 1)
    lists = stored(ranked.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("r", "neighbor", "sim"))).alias("near")))
    alone = lists.join(groups.where("n = 1").select("rep"), "rep").select(F.col("rep").alias("id"), "near")
    many = groups.where("n > 1").join(lists, "rep").select("key", "near", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))).alias("s"))
    members = vectors.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int")).join(many, ["key", "s"]).select("id", "near")
    if queries is not None:
        alone, members = alone.where(queries), members.where(queries)
    each = alone.unionByName(members).select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["neighbor"] != F.col("id")), 1, k)).alias("p", "x"))
    return each.select("id", F.col("x.neighbor").alias("neighbor"), F.col("x.sim").alias("similarity"), (F.col("p") + 1).alias("rank"))


def brute_force(ids: np.ndarray, x: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """Exact neighbours, for tests and for measuring recall."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(0, len(x), 1024):
        s = np.round(x[i : i + 1024] @ x.T, 12)
        for r in range(len(s)):
            s[r, i + r] = -9
            least = np.partition(s[r], max(0, len(x) - k))[max(0, len(x) - k)]
            top = np.flatnonzero(s[r] >= least)  # with all ties
            top = top[np.lexsort((ids[top], -s[r][top]))][:k]
            out[int(ids[i + r])] = [(int(ids[t]), float(s[r][t])) for t in top if s[r][t] > -9]
    return out
