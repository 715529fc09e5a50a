"""The registered core queries and the SQL they are compared with."""

from __future__ import annotations

from fractions import Fraction
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom import fixtures as fx
from vertexloom.graph import Graph
from vertexloom.operators import check, degree, hotkeys, index, partition
from vertexloom.operators.message import EdgeIndex, changed, combine, gather_step, semi_load
from vertexloom.operators.valid import domain, latest, valid_edges
from vertexloom.plans.iterate import Trace, pull_iterate
from vertexloom.plans.programs import CF_K, colfilter, components, pagerank, sssp
from vertexloom.session import scratch, stored
from vertexloom.sources import csc, edgelist

PARTS = 4
K_PAGERANK = 5
K_CF = 3


def _kept(g: Graph) -> Graph:
    """The graph with its edges written, as a query reads them several times."""
    return Graph(stored(g.edges), g.nv, g.weighted)


def _purchase(s, d):
    return _kept(fx.purchase(s, d))


def _sym(s, d):
    return _kept(fx.purchase(s, d).symmetrize())


def _chain(s, d):
    return _kept(fx.order_chain(s, d))


def q_csc_roundtrip(s, d, weighted: bool) -> DataFrame:
    g = fx.purchase(s, d)
    g = g if weighted else Graph(g.edges.select("src", "dst"), g.nv)
    path = scratch(s, "graph")
    csc.write_csc(g, path, degree_trailer=not weighted)
    return csc.read_csc(s, path, weighted, edges_per_partition=100_000).edges


def q_convert(s, d) -> DataFrame:
    """Text edges to a binary file with the out-degree trailer, read back: edges, and the trailer's degrees."""
    g = fx.order_chain(s, d)
    text, path = scratch(s, "edges"), scratch(s, "graph")
    edgelist.write_edge_list(g, text)
    edgelist.convert(s, text, path, g.nv)
    return csc.read_trailer(s, path).where("out_degree > 0").join(csc.read_csc(s, path).edges, F.col("id") == F.col("src")).select("src", "dst", "out_degree")


def q_edgelist(s, d) -> DataFrame:
    path = scratch(s, "edges")
    g = fx.order_chain(s, d)
    edgelist.write_edge_list(g, path)
    return edgelist.read_edge_list(s, path, g.nv).edges


def q_gather_sum(s, d) -> DataFrame:
    g = _sym(s, d)
    return gather_step(EdgeIndex(g), g.vertices.select("id", F.col("id").alias("x")), F.col("x"), "sum")


def q_scatter(s, d, how: str) -> DataFrame:
    """The push round in which the customers are the frontier: their smaller ids plus one reach the parts."""
    g = _purchase(s, d)
    front = g.vertices.select("id", F.col("id").alias("label"))
    index = EdgeIndex(g, by_source=True)
    return combine(index.scatter(front).select("dst", (F.col("label") + 1).alias("msg")), how)


def q_semi_load(s, d) -> DataFrame:
    """The states each part has to load: of the distinct sources of its edges."""
    g = _sym(s, d)
    state = g.vertices.select("id", (F.col("id") * 3).alias("x"))
    edges = partition.with_part(g.edges, partition.edge_balanced_bounds(g, PARTS), "dst")
    one = lambda p: semi_load(edges.where(F.col("part") == p), state).select(F.lit(p).alias("part"), "id", "x")
    out = one(0)
    for p in range(1, PARTS):
        out = out.unionByName(one(p))
    return out


def q_bad_endpoints(s, d) -> DataFrame:
    """Rows of the delivered edges whose end points the loader would refuse, of how many."""
    e = fx.table(s, d, "weighted_edges")
    n = domain(fx.table(s, d, "vertices"))[0]
    return degree.endpoint_report(Graph(e, n))


def q_memory(s, d) -> DataFrame:
    g = _sym(s, d)
    bounds = partition.edge_balanced_bounds(g, PARTS)
    partition.check_bounds(bounds, g.nv)
    return degree.memory_report(g, bounds, "pagerank").unionByName(degree.memory_report(g, bounds, "sssp"))


def q_trace_parts(s, d) -> DataFrame:
    g = _sym(s, d)
    t = Trace(partition.edge_balanced_bounds(g, PARTS))
    sssp(g, 0, trace=t)
    return t.part_frame(s).select("iter", "part", "row_left", "active", "mode")


def q_changed(s, d) -> DataFrame:
    g = _chain(s, d)
    old = g.vertices.select("id", F.col("id").alias("label"))
    new = pull_iterate(g, old, F.col("label"), "max", {"label": F.greatest("label", "msg")}, 1)
    return changed(old, new)


def q_pagerank(s, d, graph, col: str) -> DataFrame:
    g = graph(s, d)
    return pagerank(g, K_PAGERANK).select("id", F.round(F.col(col) * g.nv, 6).alias(col))


def q_trace(s, d, run) -> DataFrame:
    t = Trace()
    run(t)
    return t.frame(s).select("iter", "active", "mode")


def q_check_sssp(s, d, planted: bool) -> DataFrame:
    """The check of the hops, and of hops that are wrong for two of three vertices."""
    g = _sym(s, d)
    hops = sssp(g, 0)
    if planted:
        hops = hops.withColumn("hops", F.col("hops") + F.col("id") % 3)
    return check.check_sssp(g, hops, partition.edge_balanced_bounds(g, PARTS))


def q_check_components(s, d, planted: bool) -> DataFrame:
    """The check of the labels, and of labels that are wrong for four of five vertices."""
    g = _chain(s, d)
    labels = components(g)
    if planted:
        labels = labels.withColumn("label", F.col("label") - F.col("id") % 5)
    return check.check_components(g, labels, partition.edge_balanced_bounds(g, PARTS))


def q_colfilter(s, d) -> DataFrame:
    g = _sym(s, d)
    out = colfilter(g, K_CF)
    x = out.select("id", F.posexplode("v").alias("k", "val"))
    return x.select("id", "k", F.round((F.col("val") - sqrt(1 / CF_K)) * 1e6, 4).alias("delta"))


def q_p1_found(s, d) -> DataFrame:
    """Keys that hold a large share: dst with 1 % of the valid edges, degrees with 10 % of the vertices."""
    vertices = fx.table(s, d, "vertices")
    n, dense = known = domain(vertices)
    edges = valid_edges(fx.table(s, d, "weighted_edges"), vertices, ("dst",), known)
    by_dst = stored(hotkeys.dense_key_aggregate(edges, "dst", domain=n if dense else None))
    by_degree = stored(hotkeys.dense_key_aggregate(latest(vertices, "id", "loaded_at", ["degree"]), "degree"))
    a = hotkeys.heavy_keys(by_dst, "dst", Fraction(1, 100)).select(F.lit("dst").alias("key_field"), F.col("dst").alias("key_id"))
    b = hotkeys.heavy_keys(by_degree, "degree", Fraction(1, 10)).select(F.lit("degree").alias("key_field"), F.col("degree").alias("key_id"))
    return a.unionByName(b)


def q_p1_dst(s, d) -> DataFrame:
    """Every dst's count of valid edges and aggregates of their weights."""
    vertices = fx.table(s, d, "vertices")
    n, dense = known = domain(vertices)
    edges = valid_edges(fx.table(s, d, "weighted_edges"), vertices, ("dst", "weight"), known)
    return hotkeys.dense_key_aggregate(edges, "dst", "weight", domain=n if dense else None)


def q_p1_degree(s, d) -> DataFrame:
    """Every known degree's count of vertices and range of their ids."""
    v = latest(fx.table(s, d, "vertices"), "id", "loaded_at", ["degree"])
    return hotkeys.dense_key_aggregate(v, "degree", "id")


def queries() -> dict:
    return {
        "out_degree": lambda s, d: degree.out_degree(fx.purchase(s, d)),
        "in_degree": lambda s, d: degree.in_degree(fx.purchase(s, d)),
        "csc_offsets": lambda s, d: index.csc_offsets(fx.purchase(s, d)),
        "csr_offsets": lambda s, d: index.csr_offsets(fx.purchase(s, d)),
        "vertices_table": lambda s, d: index.vertices_table(fx.purchase(s, d)),
        "csc_roundtrip_edges": lambda s, d: q_csc_roundtrip(s, d, False),
        "csc_weighted_roundtrip": lambda s, d: q_csc_roundtrip(s, d, True),
        "edgelist_roundtrip": q_edgelist,
        "sorted_edges": lambda s, d: index.sorted_edges(fx.purchase(s, d)),
        "collapse_multi": lambda s, d: fx.purchase(s, d).collapse(),
        "in_neighbors_by_part": lambda s, d: partition.in_neighbors_by_part(g := _sym(s, d), partition.edge_balanced_bounds(g, PARTS)),
        "out_degree_by_part": lambda s, d: partition.out_degree_by_part(g := _sym(s, d), partition.edge_balanced_bounds(g, PARTS)),
        "edge_balanced_bounds": lambda s, d: partition.edge_balanced_bounds(_sym(s, d), PARTS),
        "gather_sum_step": q_gather_sum,
        "scatter_min_step": lambda s, d: q_scatter(s, d, "min"),
        "scatter_max_step": lambda s, d: q_scatter(s, d, "max"),
        "changed_vertices": q_changed,
        "pagerank": lambda s, d: q_pagerank(s, d, _chain, "value"),
        "pagerank_rank": lambda s, d: q_pagerank(s, d, _sym, "rank"),
        "pagerank_weighted_edges": lambda s, d: q_pagerank(s, d, lambda s, d: _kept(fx.weighted(s, d)), "value"),
        "sssp_hops": lambda s, d: sssp(_sym(s, d), 0),
        "sssp_push_only": lambda s, d: sssp(_sym(s, d), 0, mode="push"),
        "sssp_pull_only": lambda s, d: sssp(_sym(s, d), 0, mode="pull"),
        "sssp_weighted_edges": lambda s, d: sssp(_kept(fx.weighted(s, d)), 305, nullable=True),
        "components_directed": lambda s, d: components(_chain(s, d)),
        "components_symmetric": lambda s, d: components(_purchase(s, d), symmetrize=True),
        "frontier_trace_sssp": lambda s, d: q_trace(s, d, lambda t: sssp(_sym(s, d), 0, trace=t)),
        "frontier_trace_cc": lambda s, d: q_trace(s, d, lambda t: components(_sym(s, d), trace=t)),
        "frontier_trace_by_part": q_trace_parts,
        "check_sssp": lambda s, d: q_check_sssp(s, d, False),
        "check_components": lambda s, d: q_check_components(s, d, False),
        "check_sssp_planted": lambda s, d: q_check_sssp(s, d, True),
        "check_components_planted": lambda s, d: q_check_components(s, d, True),
        "semi_join_load": q_semi_load,
        "bad_endpoints": q_bad_endpoints,
        "transposed_edges": lambda s, d: index.transpose(fx.purchase(s, d)),
        "csr_offsets_by_part": lambda s, d: partition.csr_offsets_by_part(g := _sym(s, d), partition.edge_balanced_bounds(g, PARTS)),
        "converted_edges": q_convert,
        "memory_report": q_memory,
        "colfilter": q_colfilter,
        "graph_stats": lambda s, d: degree.graph_stats(fx.purchase(s, d)),
        "p1_found": q_p1_found,
        "p1_dst_aggregates": q_p1_dst,
        "p1_degree_counts": q_p1_degree,
    }


# --- SQL ---------------------------------------------------------------------------------------------

_PURCHASE = """e AS (SELECT o_custkey AS src, l_partkey + (SELECT count(*) FROM customer) AS dst, CAST(l_quantity AS INT) AS weight
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
n AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) AS nv),
v AS (SELECT unnest(range((SELECT nv FROM n))) AS id)"""
_SYM = _PURCHASE.replace("e AS (", "e0 AS (", 1) + ",\ne AS (SELECT src, dst, weight FROM e0 UNION ALL SELECT dst, src, weight FROM e0)"
_CHAIN = """e AS (SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst
  FROM orders) WHERE dst IS NOT NULL),
n AS (SELECT count(*) AS nv FROM orders),
v AS (SELECT unnest(range((SELECT nv FROM n))) AS id)"""
_VALID = """valid AS (SELECT edge_id, src, dst, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC) AS rn FROM weighted_edges)
  WHERE rn = 1 AND src IN (SELECT id FROM vertices) AND dst IN (SELECT id FROM vertices))"""
_KNOWN = """known AS (SELECT id, degree FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM vertices) WHERE rn = 1 AND degree IS NOT NULL)"""
_WEIGHTED = _VALID + """,
e AS (SELECT src, dst, weight FROM valid WHERE weight IS NOT NULL),
n AS (SELECT max(id) + 1 AS nv FROM vertices),
v AS (SELECT unnest(range((SELECT nv FROM n))) AS id)"""
_BIG = "CAST({} AS BIGINT)"


def _degrees(end: str) -> str:
    return f"SELECT v.id, CAST(count(e.{end}) AS BIGINT) AS c FROM v LEFT JOIN e ON e.{end} = v.id GROUP BY v.id"


def _pagerank_sql(graph: str, k: int, out: str) -> str:
    steps = "".join(
        f""",
x{i} AS MATERIALIZED (SELECT d.id, (0.85::DOUBLE / nv + 0.15::DOUBLE * coalesce(s, 0)) / greatest(1, c) AS x
  FROM d CROSS JOIN n LEFT JOIN (SELECT dst, sum(x) AS s FROM e JOIN x{i - 1} ON id = src GROUP BY dst) t ON t.dst = d.id)"""
        for i in range(1, k + 1)
    )
    value = "x" if out == "value" else "x * greatest(1, c)"
    return f"""WITH {graph}, d AS MATERIALIZED ({_degrees('src')}),
x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / nv / greatest(1, c) AS x FROM d CROSS JOIN n){steps}
SELECT d.id, round({value} * nv, 6) AS {out} FROM x{k} JOIN d USING (id) CROSS JOIN n"""


def _hops_sql(graph: str, bound: int, start: int = 0) -> str:
    return f"""WITH RECURSIVE {graph}, b(id, h) AS (SELECT {start}::BIGINT, 0::BIGINT UNION SELECT e.dst, b.h + 1 FROM b JOIN e ON e.src = b.id WHERE b.h < {bound}),
hop AS (SELECT v.id, coalesce(min(b.h), (SELECT nv FROM n)) AS hops FROM v LEFT JOIN b ON b.id = v.id GROUP BY v.id)
"""


def _labels_sql(graph: str) -> str:
    return f"""WITH RECURSIVE {graph}, r(id, label) USING KEY (id) AS (SELECT id, id FROM v UNION
  (SELECT e.dst, max(r.label) FROM r JOIN e ON e.src = r.id JOIN recurring.r k ON k.id = e.dst WHERE r.label > k.label GROUP BY e.dst))
"""


def _bounds_sql(parts: int) -> str:
    return f"""{_SYM}, d AS ({_degrees('dst')}),
o AS MATERIALIZED (SELECT id, sum(c) OVER (ORDER BY id) AS p FROM d),
c AS (SELECT ceil((SELECT count(*) FROM e) / {parts}.0) AS cap),
cuts(part, row_left, row_right, base) AS (
  SELECT 0, 0::BIGINT, (SELECT min(id) FROM o, c WHERE p > cap), (SELECT min(p) FROM o, c WHERE p > cap)
  UNION ALL SELECT part + 1, row_right + 1, (SELECT min(id) FROM o, c WHERE p > base + cap), (SELECT min(p) FROM o, c WHERE p > base + cap)
  FROM cuts WHERE part < {parts - 1} AND row_right IS NOT NULL),
bounds AS (SELECT part, row_left, CASE WHEN part = {parts - 1} OR row_right IS NULL THEN (SELECT nv FROM n) - 1 ELSE row_right END AS row_right FROM cuts)"""


def _cf_sql(k: int) -> str:
    start = sqrt(1 / CF_K)
    steps = "".join(
        f""",
x{i} AS MATERIALIZED (SELECT x.id, x.k, x.val + 3.5e-7::DOUBLE * (coalesce(g.s, 0) - 0.001::DOUBLE * x.val) AS val FROM x{i - 1} x LEFT JOIN (
  SELECT q.dst AS id, u.k, sum(q.err * u.val) AS s FROM (
    SELECT e.rid, e.src, e.dst, e.weight - sum(a.val * b.val) AS err FROM er e JOIN x{i - 1} a ON a.id = e.src JOIN x{i - 1} b ON b.id = e.dst AND b.k = a.k
    GROUP BY e.rid, e.src, e.dst, e.weight) q JOIN x{i - 1} u ON u.id = q.src GROUP BY q.dst, u.k) g ON g.id = x.id AND g.k = x.k)"""
        for i in range(1, k + 1)
    )
    return f"""WITH {_SYM}, er AS MATERIALIZED (SELECT row_number() OVER () AS rid, src, dst, weight FROM e),
x0 AS MATERIALIZED (SELECT id, CAST(k AS INT) AS k, {start!r}::DOUBLE AS val FROM v CROSS JOIN (SELECT unnest(range({CF_K})) AS k)){steps}
SELECT id, k, round((val - {start!r}::DOUBLE) * 1e6, 4) AS delta FROM x{k}"""


def _trace_sssp_sql(bound: int = 12) -> str:
    """A vertex changes in the round of its hop; the round after the last is the one without change."""
    return (
        _hops_sql(_SYM, bound)
        + """, a AS (SELECT hops - 1 AS iter, count(*) AS active FROM hop WHERE hops > 0 AND hops < (SELECT nv FROM n) GROUP BY 1),
z AS (SELECT iter, active FROM a UNION ALL SELECT coalesce(max(iter), -1) + 1, 0 FROM a)
SELECT CAST(iter AS INT) AS iter, CAST(active AS BIGINT) AS active,
  CASE WHEN coalesce(lag(active) OVER (ORDER BY iter), 1) > (SELECT nv // 16 FROM n) THEN 'pull' ELSE 'push' END AS mode FROM z"""
    )


def _trace_parts_sql(bound: int = 12) -> str:
    """As the trace, by part: a vertex changes in the round of its hop."""
    return (
        _hops_sql(_bounds_sql(PARTS), bound)
        + """, a AS (SELECT hops - 1 AS iter, count(*) AS active FROM hop WHERE hops > 0 AND hops < (SELECT nv FROM n) GROUP BY 1),
z AS (SELECT iter, active FROM a UNION ALL SELECT coalesce(max(iter), -1) + 1, 0 FROM a),
w AS (SELECT iter, CASE WHEN coalesce(lag(active) OVER (ORDER BY iter), 1) > (SELECT nv // 16 FROM n) THEN 'pull' ELSE 'push' END AS mode FROM z)
SELECT CAST(iter AS INT) AS iter, part, row_left, (SELECT count(*) FROM hop WHERE hops - 1 = w.iter AND id BETWEEN row_left AND row_right) AS active, mode FROM w CROSS JOIN bounds"""
    )


def _trace_cc_sql(rounds: int = 8) -> str:
    steps = "".join(
        f""",
l{i} AS MATERIALIZED (SELECT l.id, greatest(l.label, coalesce(m, l.label)) AS label, l.label AS old FROM l{i - 1} l
  LEFT JOIN (SELECT dst, max(label) AS m FROM e JOIN l{i - 1} ON id = src GROUP BY dst) t ON t.dst = l.id)"""
        for i in range(1, rounds + 1)
    )
    counts = " UNION ALL ".join(f"SELECT {i - 1} AS iter, count(*) FILTER (WHERE label <> old) AS active FROM l{i}" for i in range(1, rounds + 1))
    return f"""WITH {_SYM}, l0 AS (SELECT id, id AS label, id AS old FROM v){steps}, a AS ({counts}),
z AS (SELECT *, lag(active) OVER (ORDER BY iter) AS before FROM a)
SELECT CAST(iter AS INT) AS iter, CAST(active AS BIGINT) AS active,
  CASE WHEN coalesce(before, (SELECT nv FROM n)) > (SELECT nv // 16 FROM n) THEN 'pull' ELSE 'push' END AS mode
FROM z WHERE before IS NULL OR before > 0"""


def oracle_sql() -> dict:
    scatter = "WITH " + _PURCHASE + " SELECT dst AS id, {}(src + 1) AS msg FROM e GROUP BY dst"
    bounds = "WITH RECURSIVE " + _bounds_sql(PARTS)
    part = "JOIN bounds ON e.dst BETWEEN row_left AND row_right"
    hop_sym = _hops_sql(_SYM, 12)
    nine = lambda g: _bounds_sql(PARTS).replace(_SYM, g)
    hop_checked = _hops_sql(nine(_SYM).replace("WITH RECURSIVE ", ""), 12)
    label_checked = _labels_sql(nine(_CHAIN))
    mistakes = """, planted AS (SELECT id, {value} AS x FROM {labels})
SELECT part, CAST(count(*) FILTER (WHERE {wrong}) AS BIGINT) AS mistakes, count(*) FILTER (WHERE {wrong}) = 0 AS passed
FROM bounds LEFT JOIN e ON e.dst BETWEEN row_left AND row_right LEFT JOIN planted a ON a.id = e.src LEFT JOIN planted b ON b.id = e.dst GROUP BY part"""
    wrong_hops, wrong_labels = "a.x <> (SELECT nv FROM n) AND b.x > a.x + 1", "b.x < a.x"
    return {
        "out_degree": f"WITH {_PURCHASE}, d AS ({_degrees('src')}) SELECT id, c AS out_degree FROM d",
        "in_degree": f"WITH {_PURCHASE}, d AS ({_degrees('dst')}) SELECT id, c AS in_degree FROM d",
        "csc_offsets": f"WITH {_PURCHASE}, d AS ({_degrees('dst')}) SELECT id, c AS in_degree, CAST(sum(c) OVER (ORDER BY id) AS BIGINT) AS in_end FROM d",
        "csr_offsets": f"WITH {_PURCHASE}, d AS ({_degrees('src')}) SELECT id, c AS out_degree, CAST(sum(c) OVER (ORDER BY id) AS BIGINT) AS out_end FROM d",
        "vertices_table": f"WITH {_PURCHASE}, i AS ({_degrees('dst')}), o AS ({_degrees('src')}) SELECT i.id, CAST(sum(i.c) OVER (ORDER BY i.id) AS BIGINT) AS in_end, o.c AS out_degree FROM i JOIN o USING (id)",
        "csc_roundtrip_edges": f"WITH {_PURCHASE} SELECT src, dst FROM e",
        "csc_weighted_roundtrip": f"WITH {_PURCHASE} SELECT src, dst, weight FROM e",
        "edgelist_roundtrip": f"WITH {_CHAIN} SELECT src, dst FROM e",
        "sorted_edges": f"WITH {_PURCHASE} SELECT src, dst, weight FROM e ORDER BY dst, src, weight",
        "collapse_multi": f"WITH {_PURCHASE} SELECT src, dst, count(*) AS m FROM e GROUP BY src, dst",
        "in_neighbors_by_part": f"{bounds} SELECT DISTINCT part, src FROM e {part}",
        "out_degree_by_part": f"{bounds} SELECT part, src, count(*) AS out_degree FROM e {part} GROUP BY part, src",
        "edge_balanced_bounds": f"{bounds} SELECT part, row_left, row_right FROM bounds",
        "gather_sum_step": f"WITH {_SYM} SELECT dst AS id, CAST(sum(src) AS BIGINT) AS msg FROM e GROUP BY dst",
        "scatter_min_step": scatter.format("min"),
        "scatter_max_step": scatter.format("max"),
        "changed_vertices": f"WITH {_CHAIN} SELECT dst AS id, dst AS old, max(src) AS new FROM e GROUP BY dst HAVING max(src) > dst",
        "pagerank": _pagerank_sql(_CHAIN, K_PAGERANK, "value"),
        "pagerank_rank": _pagerank_sql(_SYM, K_PAGERANK, "rank"),
        "pagerank_weighted_edges": _pagerank_sql(_WEIGHTED, K_PAGERANK, "value"),
        "sssp_hops": hop_sym + "SELECT id, hops FROM hop",
        "sssp_push_only": hop_sym + "SELECT id, hops FROM hop",
        "sssp_pull_only": hop_sym + "SELECT id, hops FROM hop",
        "sssp_weighted_edges": _hops_sql(_WEIGHTED, 60, 305) + "SELECT id, CASE WHEN hops < (SELECT nv FROM n) THEN hops END AS hops FROM hop",
        "components_directed": _labels_sql(_CHAIN) + "SELECT id, label FROM r",
        "components_symmetric": _labels_sql(_SYM) + "SELECT id, label FROM r",
        "frontier_trace_sssp": _trace_sssp_sql(),
        "frontier_trace_cc": _trace_cc_sql(),
        "frontier_trace_by_part": _trace_parts_sql(),
        "check_sssp": hop_checked + mistakes.format(value="hops", labels="hop", wrong=wrong_hops),
        "check_components": label_checked + mistakes.format(value="label", labels="r", wrong=wrong_labels),
        "check_sssp_planted": hop_checked + mistakes.format(value="hops + id % 3", labels="hop", wrong=wrong_hops),
        "check_components_planted": label_checked + mistakes.format(value="label - id % 5", labels="r", wrong=wrong_labels),
        "semi_join_load": f"{bounds} SELECT DISTINCT part, src AS id, src * 3 AS x FROM e {part}",
        "bad_endpoints": """WITH n AS (SELECT max(id) + 1 AS nv FROM vertices), b AS (SELECT
  coalesce(src BETWEEN 0 AND (SELECT nv FROM n) - 1, false) AS s, coalesce(dst BETWEEN 0 AND (SELECT nv FROM n) - 1, false) AS d FROM weighted_edges)
SELECT count(*) AS n_edges, count(*) FILTER (WHERE NOT s) AS bad_src, count(*) FILTER (WHERE NOT d) AS bad_dst, count(*) FILTER (WHERE NOT (s AND d)) AS bad_edges FROM b""",
        "transposed_edges": f"WITH {_PURCHASE} SELECT src, dst, weight FROM e",
        "csr_offsets_by_part": f"""{bounds}, local AS (SELECT part, src, count(*) AS out_degree FROM e {part} GROUP BY part, src)
SELECT part, src, out_degree, CAST(sum(out_degree) OVER (ORDER BY part, src) AS BIGINT) AS out_end FROM local""",
        "converted_edges": f"WITH {_CHAIN}, d AS ({_degrees('src')}) SELECT src, dst, c AS out_degree FROM e JOIN d ON d.id = src",
        "memory_report": f"""{bounds}, m AS (SELECT part, count(*) AS edges, any_value(row_right) - any_value(row_left) + 1 AS vertices FROM e {part} GROUP BY part),
q AS (SELECT sum(8 + 4 * ((vertices - 1) // 16 + 100)) AS queue, sum(edges) AS ne, max(edges) AS most FROM m),
b AS (SELECT 'pagerank' AS program, part, edges, vertices, edges * 8 + vertices * 24 + nv * 4 AS part_bytes, ne * 4 + nv * 8 + nv * 8 + nv * 4 AS shared_bytes FROM m, q, n
UNION ALL SELECT 'sssp', part, edges, vertices, edges * 12 + vertices * 16 + nv * 12 + 2 * queue, ne * 4 + nv * 8 + nv * 8 + 2 * queue + nv * 8 + most * 4 FROM m, q, n)
SELECT program, part, edges, vertices, CAST(part_bytes AS BIGINT) AS part_bytes, CAST(max(part_bytes) OVER (PARTITION BY program) AS BIGINT) AS max_part_bytes, CAST(shared_bytes AS BIGINT) AS shared_bytes,
  CAST(max(part_bytes) OVER (PARTITION BY program) AS BIGINT) // 1048576 + 1 AS part_mb, CAST(shared_bytes AS BIGINT) // 1048576 + 1 AS shared_mb FROM b""",
        "colfilter": _cf_sql(K_CF),
        "graph_stats": f"""WITH {_PURCHASE}, m AS (SELECT count(*) AS ne FROM e) SELECT nv, ne, CAST(12 + 8 * nv + 8 * ne AS BIGINT) AS file_bytes,
  CAST(16 * nv AS BIGINT) AS state_bytes, CAST(20 * ne AS BIGINT) AS edge_bytes FROM n CROSS JOIN m""",
        "p1_found": f"""WITH {_VALID}, {_KNOWN} SELECT 'dst' AS key_field, dst AS key_id FROM valid GROUP BY dst HAVING count(*) * 100 >= (SELECT count(*) FROM valid)
UNION ALL SELECT 'degree', degree FROM known GROUP BY degree HAVING count(*) * 10 >= (SELECT count(*) FROM known)""",
        "p1_dst_aggregates": f"""WITH {_VALID} SELECT dst, count(*) AS n, count(weight) AS n_values, CAST(sum(weight) AS BIGINT) AS sum,
  CAST(min(weight) AS BIGINT) AS min, CAST(max(weight) AS BIGINT) AS max FROM valid GROUP BY dst""",
        "p1_degree_counts": f"WITH {_KNOWN} SELECT degree, count(*) AS n, count(id) AS n_values, CAST(sum(id) AS BIGINT) AS sum, min(id) AS min, max(id) AS max FROM known GROUP BY degree",
    }
