import random
import struct

import pytest
import simulate as sim
from pyspark.sql import functions as F

from vertexloom import Graph
from vertexloom.operators import check, degree, index, message, partition
from vertexloom.plans.iterate import Trace, pull_iterate, push_iterate
from vertexloom.plans.programs import colfilter, components, pagerank, sssp

T1 = (5, [(0, 1), (0, 1), (1, 2), (2, 0), (2, 2), (2, 3)])
T2 = (6, [(0, 1), (1, 0), (3, 4), (4, 5), (5, 3)])
T3 = (6, [(i, i + 1) for i in range(5)])
T4 = (6, [(i + 1, i) for i in range(5)])
GOLDEN = {"T1": T1, "T2": T2, "T3": T3, "T4": T4}


def graph(spark, nv, edges, weighted=False):
    cols = "src long, dst long" + (", weight int" if weighted else "")
    return Graph.from_edges(spark.createDataFrame(edges, cols), nv, weighted)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def random_graph(seed, nv=40, ne=90):
    r = random.Random(seed)
    return nv, [(r.randrange(nv), r.randrange(nv)) for _ in range(ne)]


def test_golden_pagerank(spark):
    g = graph(spark, *T1)
    assert [round(x, 6) for x in column(pagerank(g, 1), "value")] == [0.09, 0.2, 0.07, 0.18, 0.17]
    assert [round(x, 6) for x in column(pagerank(g, 5), "value")] == [0.090252, 0.197076, 0.070022, 0.180503, 0.17]
    assert column(pagerank(g, 1), "out_degree") == [2, 1, 3, 0, 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_simulation(spark, seed):
    nv, edges = random_graph(seed)
    g = graph(spark, nv, edges)
    assert column(pagerank(g, 3), "value") == pytest.approx(sim.pagerank(nv, edges, 3), abs=1e-12)
    assert column(sssp(g, 3), "hops") == sim.hops(nv, edges, 3)
    assert column(components(g), "label") == sim.labels(nv, edges)


def test_rank_sums_to_one_without_dangling(spark):
    nv, edges = random_graph(5)
    g = graph(spark, nv, edges).symmetrize()
    edges = edges + [(b, a) for a, b in edges] + [(v, v) for v in range(nv)]
    g = graph(spark, nv, edges)
    assert sum(column(pagerank(g, 4), "rank")) == pytest.approx(1)


@pytest.mark.parametrize(
    "name,labels,active,hops,hop_active",
    [
        ("T1", [2, 2, 2, 3, 4], [1, 1, 0], [0, 1, 2, 3, 5], [1, 1, 1, 0]),
        ("T2", [1, 1, 2, 5, 5, 5], [2, 1, 0], [0, 1, 6, 6, 6, 6], [1, 0]),
        ("T4", [5] * 6, [5, 4, 3, 2, 1, 0], [0] + [6] * 5, [0]),
    ],
)
def test_golden_fixpoints(spark, name, labels, active, hops, hop_active):
    g = graph(spark, *GOLDEN[name])
    t = Trace()
    assert column(components(g, trace=t), "label") == labels
    assert [r[1] for r in t.rows] == active
    t = Trace()
    assert column(sssp(g, 0, trace=t), "hops") == hops
    assert [r[1] for r in t.rows] == hop_active


def test_modes_agree_and_duplicates_do_not_matter(spark):
    nv, edges = random_graph(7)
    want = sim.hops(nv, edges, 0)
    for mode in ("push", "pull"):
        assert column(sssp(graph(spark, nv, edges + edges[:20]), 0, mode=mode), "hops") == want
        assert column(components(graph(spark, nv, edges), mode=mode), "label") == sim.labels(nv, edges)


def test_start_outside_and_empty_graphs(spark):
    g = graph(spark, *T3)
    assert column(sssp(g, 99), "hops") == [6] * 6
    assert column(sssp(g, 99, nullable=True), "hops") == [None] * 6
    none = graph(spark, 1, [])
    assert column(sssp(none, 0), "hops") == [0] and column(components(none), "label") == [0]
    assert column(pagerank(none, 2), "value") == pytest.approx([0.85])
    empty = graph(spark, 0, [])
    assert components(empty).count() == 0 and index.csc_offsets(empty).count() == 0


def test_bad_arguments(spark):
    g = graph(spark, *T1)
    for call in (lambda: pagerank(g, 0), lambda: colfilter(g, 1), lambda: graph(spark, 2, [(0, 2)]), lambda: graph(spark, 2, [(0, None)])):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        push_iterate(g, g.vertices.select("id", F.col("id").alias("label")), F.col("label"), "sum", 5)


def test_colfilter(spark):
    edges = [(0, 1, 3), (1, 0, 5), (0, 1, -2), (2, 1, 4)]
    g = graph(spark, 4, edges, weighted=True)
    got = column(colfilter(g, 3), "v")
    for a, b in zip(got, sim.colfilter(4, edges, 3)):
        assert a == pytest.approx(b, abs=1e-15)
        assert max(a) - min(a) == 0


def test_symmetric_components_are_union_find(spark):
    nv, edges = random_graph(11, ne=30)
    g = graph(spark, nv, edges)
    got = {r.id: r.label for r in components(g, symmetrize=True).collect()}
    groups = sim.union_find(edges + [(v, v) for v in range(nv)])
    assert got == {v: max(groups[v]) for v in range(nv)}


def test_shuffled_state_equals_broadcast(spark):
    nv, edges = random_graph(3)
    edges += [(0, d) for d in range(nv)] * 3
    g = graph(spark, nv, edges)
    s = g.vertices.select("id", F.col("id").alias("x"))
    a = message.EdgeIndex(g).gather(s)
    i = message.EdgeIndex(g, broadcast_bytes=0, rows_per_task=10)
    b = i.gather(s)
    assert i.hot.count() >= 1
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())
    t = s.withColumnRenamed("x", "y")
    assert sorted(i.with_target(b, t).select("src", "dst", "x", "y").collect()) == sorted((x, y, x, y) for x, y in edges)


def test_offsets_and_bounds(spark):
    for name, ends in (("T1", [1, 3, 5, 6, 6]), ("T2", [1, 2, 2, 3, 4, 5]), ("T3", [0, 1, 2, 3, 4, 5])):
        assert column(index.csc_offsets(graph(spark, *GOLDEN[name])), "in_end") == ends
    want = {("T1", 2): [(0, 2), (3, 4)], ("T1", 3): [(0, 1), (2, 3), (4, 4)], ("T4", 3): [(0, 2), (3, 5), (6, 5)], ("T2", 2): [(0, 4), (5, 5)]}
    for (name, p), bounds in want.items():
        for limit in (10, 0):
            rows = partition.edge_balanced_bounds(graph(spark, *GOLDEN[name]), p, limit).orderBy("part").collect()
            assert [(r.row_left, r.row_right) for r in rows] == bounds, (name, p)


def test_prefix_sum_blocks(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    got = column(index.prefix_sum(df, 1000, "x", "s", blocks=13), "s")
    total, want = 0, []
    for i in range(1000):
        total += i % 7
        want.append(total)
    assert got == want


def test_checks_are_two_sided(spark):
    g = graph(spark, *T1)
    good, bad = components(g), g.vertices.select("id", F.lit(9).cast("long").alias("label"))
    assert check.check_components(g, good).first().passed
    assert check.unattained(g, good, "label", 0, F.col("label") == F.col("id")).count() == 0
    assert check.check_components(g, bad).first().passed  # one-sided: all the same label passes ...
    low = g.vertices.select("id", F.col("id").alias("label"))
    assert not check.check_components(g, low).first().passed
    h = sssp(g, 0)
    assert check.check_sssp(g, h, partition.edge_balanced_bounds(g, 2)).where("passed").count() == 2
    wrong = h.withColumn("hops", F.when(F.col("id") == 3, 4).otherwise(F.col("hops")))
    assert not check.check_sssp(g, wrong).first().passed
    assert check.unattained(g, wrong, "hops", 1, (F.col("hops") == 5) | (F.col("id") == 0)).count() == 1  # ... the other side doesn't


def test_generic_pull_program(spark):
    g = graph(spark, *T2)
    s = g.vertices.select("id", F.lit(1).cast("long").alias("x"))
    got = pull_iterate(g, s, F.col("x"), "sum", {"x": F.col("x") + F.coalesce("msg", F.lit(0))}, 2)
    assert column(got, "x") == [4, 4, 1, 4, 4, 4]


def test_degrees(spark):
    g = graph(spark, *T1)
    assert column(degree.out_degree(g), "out_degree") == [2, 1, 3, 0, 0]
    assert column(degree.in_degree(g), "in_degree") == [1, 2, 2, 1, 0]
    assert column(index.vertices_table(g), "in_end") == [1, 3, 5, 6, 6]
    assert degree.bad_endpoints(Graph(g.edges, 3)) == 1
    assert degree.graph_stats(g).first().file_bytes == 12 + 8 * 5 + 4 * 6
    assert {tuple(r) for r in g.collapse().collect()} >= {(0, 1, 2)}


def test_csc_file(spark, tmp_path):
    from vertexloom.sources import csc

    r = random.Random(1)
    edges = [(r.randrange(9), r.choice([0, 3, 8]), r.randrange(-5, 5)) for _ in range(50)]
    path = str(tmp_path / "g.csc")
    for weighted, trailer in ((True, False), (False, True), (False, False)):
        g = graph(spark, 9, edges, weighted=True)
        g = g if weighted else Graph(g.edges.select("src", "dst"), 9)
        csc.write_csc(g, path, degree_trailer=trailer)
        back = csc.read_csc(spark, path, weighted, edges_per_partition=7)
        assert back.nv == 9 and sorted(map(tuple, back.edges.collect())) == sorted(e if weighted else e[:2] for e in edges)
    data = open(path, "rb").read()
    assert struct.unpack("<IQ", data[:12]) == (9, 50) and len(data) == 12 + 72 + 200
    assert struct.unpack("<9Q", data[12:84])[-1] == 50
    open(path, "wb").write(data[:-3])
    with pytest.raises(ValueError):
        csc.read_csc(spark, path)
    csc.write_csc(graph(spark, 3, []), path)
    assert csc.read_csc(spark, path).edges.count() == 0


def test_edge_list(spark, tmp_path):
    from vertexloom.sources import csc, edgelist

    p = tmp_path / "e.txt"
    p.write_text("# c\n0 1\n\n0x1F  017\n 2\t0 \n")
    g = edgelist.read_edge_list(spark, str(p), ne=3, comment="#")
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1), (2, 0), (31, 15)] and g.nv == 32
    with pytest.raises(ValueError):
        edgelist.read_edge_list(spark, str(p), ne=4, comment="#")
    with pytest.raises(Exception, match="not an edge"):
        edgelist.read_edge_list(spark, str(p))
    p.write_text("0 1\n1 2\n")
    edgelist.convert(spark, str(p), str(tmp_path / "o.csc"))
    assert sorted(map(tuple, csc.read_csc(spark, str(tmp_path / "o.csc")).edges.collect())) == [(0, 1), (1, 2)]


def test_command_line(spark, tmp_path, capsys):
    from vertexloom import cli
    from vertexloom.sources import csc

    path = str(tmp_path / "g.csc")
    csc.write_csc(graph(spark, *T1), path)
    assert cli.main(["sssp", "-file", path, "-start", "0", "-check", "-v", "-ll:gpu", "2", "-ll:fsize", "9"], spark) == 0
    said = capsys.readouterr().out
    assert said.count("[PASS]") == 2 and "max_part_bytes" in said and "row_left" in said
    assert cli.main(["pagerank", "-file", path, "-ni", "2", "-output", str(tmp_path / "o")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5


@pytest.mark.parametrize("mode", ["auto", "push", "pull"])
def test_loop_over_a_state_that_is_not_broadcast(spark, mode, monkeypatch):
    from vertexloom.plans import iterate

    monkeypatch.setattr(iterate, "DELTAS", 2)
    nv, edges = 60, [(i, i + 1) for i in range(30)] + random_graph(9, 60, 40)[1]
    g = graph(spark, nv, edges)
    for start, how, message, frontier, want in (
        (F.when(F.col("id") == 0, 0).otherwise(nv).cast("long"), "min", F.col("label") + 1, F.col("id") == 0, sim.hops(nv, edges, 0)),
        (F.col("id"), "max", F.col("label"), None, sim.labels(nv, edges)),
    ):
        state = g.vertices.select("id", start.alias("label"))
        args = (g, state, message, how, 1 if how == "min" else nv, frontier, mode)
        small, large = Trace(partition.edge_balanced_bounds(g, 2)), Trace()
        assert column(push_iterate(*args, trace=small), "label") == want
        assert column(push_iterate(*args, trace=large, broadcast_bytes=0), "label") == want
        assert [r[:3] for r in small.rows] == [r[:3] for r in large.rows]
        assert [sum(p[3] for p in small.part_rows if p[0] == r[0]) for r in small.rows] == [r[1] for r in small.rows]


def test_no_more_than_two_rounds_are_kept(spark):
    import os

    from vertexloom.session import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    column(components(graph(spark, *T4)), "label")
    assert len(set(os.listdir(root)) - before) <= 1  # the result
    column(pagerank(graph(spark, *T1), 4), "value")
    assert len(set(os.listdir(root)) - before) <= 2


def test_ranges_of_changed_vertices():
    from vertexloom.plans.iterate import _Marks

    m = _Marks(504_000)
    assert m.within({"w0": 1 | 1 << 5, "w7": 1 << 62}) is not None
    assert m.within({f"w{w}": (1 << 63) - 1 for w in range(8)}) is None and m.within({}) is None


def test_states_to_load_and_row_pointers_of_parts(spark):
    g = graph(spark, *T1)
    s = g.vertices.select("id", F.col("id").alias("x"))
    assert column(message.semi_load(g.edges, s), "id") == [0, 1, 2]
    bounds = partition.edge_balanced_bounds(g, 2)
    partition.check_bounds(bounds, 5)
    for wrong in ("part int, row_left long, row_right long",):
        for rows in ([(0, 0, 2)], [(0, 0, 2), (1, 2, 4)], [(0, 0, 1), (1, 3, 4)]):
            with pytest.raises(ValueError):
                partition.check_bounds(spark.createDataFrame(rows, wrong), 5)
    got = [tuple(r) for r in partition.csr_offsets_by_part(g, bounds).orderBy("part", "src").collect()]
    assert got == [(0, 0, 2, 2), (0, 1, 1, 3), (0, 2, 2, 5), (1, 2, 1, 6)]
    r = degree.memory_report(g, bounds, "pagerank").collect()
    assert r[0].max_part_bytes == max(x.part_bytes for x in r) and r[0].part_mb == 1
    assert tuple(degree.endpoint_report(Graph(g.edges, 3)).first()) == (6, 0, 1, 1)


def test_file_streamed_through_the_driver(spark, tmp_path):
    from vertexloom.sources import csc, paths

    edges = [(0, 1, 3), (1, 0, 5), (0, 1, -2), (2, 1, 4)]
    g = graph(spark, 3, edges, weighted=True)
    a, b = f"file://{tmp_path}/a b/g.csc", f"file://{tmp_path}/s.csc"
    csc.write_csc(g, a)
    is_local = csc.is_local
    csc.is_local = lambda path: False
    try:
        csc.write_csc(g, b)
        csc.write_csc(Graph(g.edges.select("src", "dst"), 3), b + "2", degree_trailer=True)
    finally:
        csc.is_local = is_local
    assert open(paths.local_path(a), "rb").read() == open(paths.local_path(b), "rb").read()
    assert [tuple(r) for r in csc.read_trailer(spark, b + "2").orderBy("id").collect()] == [(0, 2), (1, 1), (2, 1)]
    with pytest.raises(OSError):
        paths.arrow_file("nosuch://x/y")
