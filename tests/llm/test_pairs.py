import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import queries, similar, stars, together, topn


def best(rows, n):
    top = defaultdict(dict)
    for g, i, s in rows:
        if None not in (g, i, s) and s == s:
            top[g][i] = max(s, top[g].get(i, s))
    return {(g, i, s) for g, d in top.items() for i, s in sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n]}


def test_top_n_with_a_hot_group_ties_and_repeats(spark):
    r = random.Random(1)
    rows = [(1 if r.random() < 0.5 else r.randrange(200), r.randrange(900), r.randrange(-5, 30)) for _ in range(20_000)]
    rows += rows[:500] + [(None, 1, 1), (1, None, 1), (1, 1, None)]
    df = spark.createDataFrame(rows, "g long, i long, s int").withColumn("rank", F.lit("clash"))
    for per_file, per_group in ((1_000, 100), (10**6, 4_000)):
        got, report = topn.top_n(df, "g", "i", "s", 5, per_file, per_group)
        assert {(x.g, x.i, x.s) for x in got.collect()} == best(rows, 5)
        assert got.where("rank > 5 or rank < 1").count() == 0


def test_top_n_skips_row_groups(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("i"), (F.col("id") * 7919 % 100_003).cast("double").alias("s"))
    got, report = topn.top_n(df, "g", "i", "s", 3, rows_per_group=2_000)
    r = report.first()
    assert r.row_groups_read < r.row_groups / 2
    assert {(x.g, x.i, x.s) for x in got.collect()} == best([tuple(x) for x in df.collect()], 3)


def test_top_n_skips_on_the_real_table(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("no test tables")
    r = queries.q_p2_skipped(spark, sf).first()
    assert r.row_groups_read < 0.8 * r.row_groups


def test_top_n_where_files_are_handed_over(spark, monkeypatch):
    monkeypatch.setattr(topn, "_opens", lambda name: False)
    rows = [(i % 3, i, i * 7919 % 101) for i in range(5_000)]
    got, report = topn.top_n(spark.createDataFrame(rows, "g long, i long, s int"), "g", "i", "s", 5, rows_per_group=200)
    assert {(x.g, x.i, x.s) for x in got.collect()} == best(rows, 5)
    assert {x["rank"] for x in got.collect()} == {1, 2, 3, 4, 5}
    r = report.first()
    assert r.row_groups_read < r.row_groups / 2


def test_top_n_empty_nan_and_few(spark):
    none = spark.createDataFrame([], "g long, i long, s double")
    assert topn.top_n(none, "g", "i", "s")[0].count() == 0
    rows = [(1, 2, float("nan")), (1, 3, 1.5), (2, 1, -0.5)]
    got = topn.top_n(spark.createDataFrame(rows, none.schema), "g", "i", "s")[0]
    assert {(x.g, x.i, x.s, x["rank"]) for x in got.collect()} == {(1, 3, 1.5, 1), (2, 1, -0.5, 1)}
    with pytest.raises(ValueError):
        topn.top_n(none, "g", "i", "s", 0)


def groups_of(pairs):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for a in list(root):
        out[find(a)].add(a)
    return {a: g for g in out.values() for a in g}


@pytest.mark.parametrize("rows_per_task", [10**6, 4])
def test_connect(spark, rows_per_task):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    pairs += [(b, a) for a, b in pairs[:5]] + [(300, 300), (-7, 3)]
    df = spark.createDataFrame(pairs + [(None, 1), (1, None)], "src long, dst long").withColumn("u", F.lit(0))
    want = groups_of(pairs)
    assert {tuple(x) for x in stars.connect(df, label="max", rows_per_task=rows_per_task).collect()} == {(a, max(g)) for a, g in want.items()}
    if rows_per_task > 4:
        assert {tuple(x) for x in stars.connect(df).collect()} == {(a, min(g)) for a, g in want.items()}


def test_connect_empty(spark):
    assert stars.connect(spark.createDataFrame([], "src long, dst long")).count() == 0
    with pytest.raises(ValueError):
        stars.connect(spark.createDataFrame([], "src long, dst long"), label="any")


@pytest.mark.parametrize("unit_pairs,bound,bundle", [(10**6, 10**6, 10**6), (49, 10**6, 10**6), (49, 0, 60)])
def test_pairs_in_ordinary_and_huge_baskets(spark, unit_pairs, bound, bundle, monkeypatch):
    monkeypatch.setattr(together, "BUNDLE_PAIRS", bundle)
    monkeypatch.setattr(together, "GATHER", 50)
    r = random.Random(3)
    rows = [(b, r.randrange(30)) for b in range(60) for _ in range(r.randrange(1, 6))] + [(99, i) for i in range(40)]
    rows += rows[:50]
    df = spark.createDataFrame(rows + [(None, 1), (1, None)], "src long, dst long").withColumn("item", F.lit(1))
    held = defaultdict(set)
    for b, i in rows:
        held[b].add(i)
    both = Counter(p for s in held.values() for p in combinations(sorted(s), 2))
    one = Counter(i for s in held.values() for i in s)
    got = together.associations(df, unit_pairs=unit_pairs, broadcast_rows=bound).collect()
    assert {(x.item_a, x.item_b): x.n_both for x in got} == dict(both)
    for x in got:
        assert (x.n_a, x.n_b, x.n_baskets) == (one[x.item_a], one[x.item_b], len(held))
        assert x.lift == pytest.approx(x.n_both * len(held) / (x.n_a * x.n_b))


def test_pairs_empty(spark):
    assert together.associations(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_estimates_keep_their_bounds():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = similar.Codec.fit(x, 5, 64, 1)
    home = (x @ c.centers.T).argmax(axis=1)
    code, norm, own = c.encode(x, home)
    at = home == 0
    est, err = similar.estimate(c, 0, x[:200], code[at].view(np.uint64), norm[at], own[at], x[at] @ c.centers[0])
    true = x[:200] @ x[at].T
    assert (np.abs(est - true) <= err).mean() > 0.95
    assert np.abs(est - true).mean() < 0.15


def test_neighbors_with_copies_and_unusable_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 20)) * r.lognormal(size=(600, 1))
    x[200:400] = x[200]  # a third are one vector, at other lengths
    x[200:400] *= 2.0 ** r.integers(-2, 3, size=(200, 1))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    bad = [(900, None), (901, [1.0] * 19), (902, [0.0] * 20), (903, [1.0] * 19 + [None]), (904, [float("nan")] * 20), (905, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "id long, v array<double>").withColumn("rep", F.lit("clash"))
    want = similar.brute_force(np.arange(600), x, 5)
    got = defaultdict(set)
    for q in similar.most_similar(df, 5, 20, clusters=8, probes=8).collect():
        got[q.id].add((q.neighbor, round(q.similarity, 6)))
    hits = 0
    for i, near in want.items():
        assert len(got[i]) == 5
        if 200 <= i < 400:
            assert {n for n, _ in got[i]} == {n for n in range(200, 206) if n != i} if i < 206 else {n for n, _ in got[i]} == set(range(200, 205))
        hits += len({n for n, _ in near} & {n for n, _ in got[i]})
    assert hits / (5 * 600) >= 0.95
    some = similar.most_similar(df, 5, 20, queries=F.col("id") % 50 == 0, floor=0.9, clusters=8, probes=8).collect()
    assert {q.id for q in some} <= set(range(0, 600, 50)) and min(q.similarity for q in some) >= 0.9


def test_neighbors_of_few(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert similar.most_similar(df).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 20), (2, [2.0] * 20)], df.schema)
    assert {(q.id, q.neighbor) for q in similar.most_similar(two).collect()} == {(1, 2), (2, 1)}
    assert similar.most_similar(two.limit(1)).count() == 0


def test_recall_with_far_fewer_probes_than_clusters(spark):
    r = np.random.default_rng(11)
    centers = r.normal(size=(60, 20))
    x = np.concatenate([centers[r.integers(0, 60, 3000)] + 0.35 * r.normal(size=(3000, 20)), r.normal(size=(1000, 20))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    want = similar.brute_force(np.arange(len(x)), x, 5)
    got = defaultdict(set)
    for q in similar.most_similar(df, 5, 20, queries=F.col("id") % 50 == 0, probes=24).collect():  # of 126 clusters
        got[q.id].add(q.neighbor)
    asked = range(0, len(x), 50)
    assert sum(len(got[i] & {n for n, _ in want[i]}) for i in asked) / (5 * len(asked)) >= 0.9


def test_clusters_in_two_levels_and_bundles(monkeypatch):
    monkeypatch.setattr(similar, "FLAT_CLUSTERS", 8)
    x = np.random.default_rng(3).normal(size=(2000, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = similar.fit_clusters(x, 60, 1)
    assert 40 <= len(c) <= 80 and np.allclose(np.linalg.norm(c, axis=1), 1)
    size = np.bincount(similar.nearest(x, c), minlength=len(c))
    of, parts = similar.bundles(c, size, 200, 1)
    held = np.bincount(of, weights=size)
    assert len(held) == len(parts) and (held <= np.maximum(200, [size[of == i].max() for i in range(len(parts))])).all()


def test_recall_on_the_real_table(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("no test tables")
    rows = [(r.id, r.v) for r in queries._states(spark, sf).where(similar.usable("v", 20)).collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    for q in queries.q_p3_neighbors(spark, sf).collect():
        got[q.id].add(q.neighbor)
    found = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        sims = np.round(x @ x[i], 12)
        sims[i] = -9
        best = np.lexsort((ids, -sims))[:5]
        found, total = found + len(got[ids[i]] & set(ids[best].tolist())), total + 5
    assert total > 500 and found / total >= 0.9
