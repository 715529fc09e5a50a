from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import hotkeys
from vertexloom.operators.skew import hot_keys, replicated, salted
from vertexloom.operators.valid import domain, is_member, latest, valid_edges


def rows(n=5000):
    return [(7 if i % 3 == 0 else (i * i) % 101, None if i % 11 == 0 else i % 50 - 20) for i in range(n)] + [(None, 1), (100, None)]


@pytest.mark.parametrize("dom", [None, 101, 10**9])
def test_aggregates_match_a_loop(spark, dom):
    data = rows()
    df = spark.createDataFrame(data, "k long, x int").repartition(7)
    want = defaultdict(list)
    for k, x in data:
        if k is not None:
            want[k].append(x)
    got = {r[0]: tuple(r)[1:] for r in hotkeys.dense_key_aggregate(df, "k", "x", domain=dom, reducers=3).collect()}
    assert set(got) == set(want)
    for k, xs in want.items():
        v = [x for x in xs if x is not None]
        assert got[k] == (len(xs), len(v), sum(v) if v else None, min(v, default=None), max(v, default=None))


def test_counts_only_and_wide_keys(spark):
    keys = [0, 1, -5, 2**62, -(2**63), 65_535, 65_536, 10**12] * 5
    df = spark.createDataFrame([(k, "x") for k in keys], "key long, code string")
    assert {tuple(r) for r in hotkeys.dense_key_aggregate(df, "key").collect()} == set(Counter(keys).items())


def test_empty_and_all_null(spark):
    for df in (spark.createDataFrame([], "k long"), spark.createDataFrame([(None,)], "k long")):
        assert hotkeys.dense_key_aggregate(df, "k").count() == 0
        assert hotkeys.dense_key_aggregate(df, "k", domain=5).count() == 0


def test_key_outside_the_domain(spark):
    with pytest.raises(Exception, match="outside"):
        hotkeys.dense_key_aggregate(spark.createDataFrame([(5,)], "k long"), "k", domain=5).collect()


def test_dictionary_is_sent_on_when_large(spark, monkeypatch):
    monkeypatch.setattr(hotkeys, "DICTIONARY", 3)
    df = spark.createDataFrame([(i % 40,) for i in range(400)], "k long")
    assert {tuple(r) for r in hotkeys.dense_key_aggregate(df, "k").collect()} == {(i, 10) for i in range(40)}


def test_heavy_keys_compare_in_integers(spark):
    counts = spark.createDataFrame([(1, 1), (2, 99)], "k long, n long")
    assert {r.k for r in hotkeys.heavy_keys(counts, "k", Fraction(1, 100)).collect()} == {1, 2}
    assert {r.k for r in hotkeys.heavy_keys(counts, "k", Fraction(2, 100)).collect()} == {2}


def test_latest_settles_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "z"), (1, 3, "a"), (1, 3, "b"), (2, None, None), (None, 9, "q")], "id long, t int, v string")
    assert {tuple(r) for r in latest(df, "id", "t", ["v"]).collect()} == {(1, "b"), (2, None)}


def test_membership(spark):
    dense = spark.range(4).union(spark.range(1))
    holes = spark.createDataFrame([(0,), (2,), (None,), (2,)], "id long")
    e = spark.createDataFrame([(0, 2), (2, 1), (1, 3), (None, 0), (0, 9), (-1, 0)], "src long, dst long")
    assert domain(dense) == (4, True) and domain(holes) == (3, False) and domain(holes.limit(0)) == (0, True)
    assert is_member(dense, ["src", "dst"], e).count() == 3
    assert [tuple(r) for r in is_member(holes, ["src", "dst"], e).collect()] == [(0, 2)]
    assert is_member(holes.limit(0), ["src"], e).count() == 0


def test_valid_edges(spark):
    e = spark.createDataFrame(
        [(1, 0, 1, 5, 1), (1, 0, 2, 6, 2), (2, 0, 1, 5, 1), (2, None, 1, 5, 2), (3, 0, 77, 5, 1), (4, 1, 1, None, 1), (4, 1, 1, None, 1)],
        "edge_id long, src long, dst long, weight int, loaded_at int",
    )
    assert {tuple(r) for r in valid_edges(e, spark.range(3)).collect()} == {(1, 0, 2, 6), (4, 1, 1, None)}


def test_salted_join_keeps_every_row(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    small = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("y"))
    hot = hot_keys(big, "k", 300)
    assert [tuple(r) for r in hot.collect()] == [(1, 7)]
    a, b = salted(big, "k", "x", hot), replicated(small, "key", hot, "k").withColumnRenamed("_salt", "_s")
    j = a.join(b, (F.col("k") == F.col("key")) & (F.col("_salt") == F.col("_s")))
    assert j.count() == 3000 and j.where("y <> 2 * k").count() == 0
    assert a.groupBy("_salt").count().where("_salt > 0").count() == 6


@pytest.mark.parametrize("dom", [None, 3])
def test_large_sums_are_exact_or_raise(spark, dom):
    big = 2**62
    fits = spark.createDataFrame([(0, big), (0, big - 1), (1, -big), (1, -big), (2, big), (2, -big), (2, big)], "k long, x long").repartition(3)
    assert {tuple(r)[0]: r["sum"] for r in hotkeys.dense_key_aggregate(fits, "k", "x", domain=dom).collect()} == {0: 2 * big - 1, 1: -2 * big, 2: big}
    with pytest.raises(Exception, match="passes 64 bits"):
        hotkeys.dense_key_aggregate(fits.withColumn("k", F.lit(0)).where("x > 0"), "k", "x", domain=dom).collect()
