"""The registered training-data queries and the SQL they are compared with."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom import fixtures as fx
from vertexloom.llm import mixture, safety, similar, stars, together, tokens, topn
from vertexloom.operators.valid import is_member, latest, valid_edges
from vertexloom.session import stored

N_BEST = 5
DIMS = 20
MIN_COSINE = 0.99
QUERY_STEP = 50


def _best(s, d):
    edges = valid_edges(fx.table(s, d, "weighted_edges"), fx.table(s, d, "vertices"))
    return topn.top_n(edges, "dst", "src", "weight", N_BEST)


def q_p2_found(s, d) -> DataFrame:
    return _best(s, d)[0].select("dst", "src")


def q_p2_ranked(s, d) -> DataFrame:
    return _best(s, d)[0].select("dst", "src", "weight", "rank")


def q_p2_skipped(s, d) -> DataFrame:
    """How many row groups the statistics spared."""
    return _best(s, d)[1]


def _states(s, d) -> DataFrame:
    return latest(fx.table(s, d, "vertex_state"), "id", "iter", ["v"])


def q_p3_found(s, d) -> DataFrame:
    near = similar.most_similar(_states(s, d), N_BEST, DIMS, floor=MIN_COSINE)
    return near.select(F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b")).distinct()


def q_p3_neighbors(s, d) -> DataFrame:
    """The five nearest of every vertex whose id is divisible by 50, against all."""
    return similar.most_similar(_states(s, d), N_BEST, DIMS, queries=F.col("id") % QUERY_STEP == 0)


def q_p4_found(s, d) -> DataFrame:
    pairs = is_member(fx.table(s, d, "vertices"), ["src", "dst"], fx.table(s, d, "match_edges").select("src", "dst"))
    return stars.connect(pairs, label="max")


def q_p4_sizes(s, d) -> DataFrame:
    return q_p4_found(s, d).groupBy("label").agg(F.count("*").alias("n"))


def _associations(s, d) -> DataFrame:
    rows = is_member(fx.table(s, d, "vertices"), ["src"], fx.table(s, d, "basket_edges").select("src", "dst"))
    return together.associations(is_member(fx.table(s, d, "items"), ["dst"], rows))


def q_p5_found(s, d) -> DataFrame:
    a = _associations(s, d)
    strong = (F.col("n_both") >= 5) & (F.col("n_both") * 1000 >= F.col("n_baskets") * 5)
    far = F.col("n_both") * F.col("n_baskets") >= F.col("n_a") * F.col("n_b") * 3
    return a.where(strong & far).select("item_a", "item_b")


def q_p5_pairs(s, d) -> DataFrame:
    return _associations(s, d).select("item_a", "item_b", "n_both", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"))


def q_p5_huge(s, d) -> DataFrame:
    """How many baskets were split into chunks, and the pairs there are."""
    rows = is_member(fx.table(s, d, "vertices"), ["src"], fx.table(s, d, "basket_edges").select("src", "dst"))
    held = together.baskets(is_member(fx.table(s, d, "items"), ["dst"], rows), "src", "dst")
    pairs, n = together.pair_counts(held)
    return pairs.agg(F.lit(n).cast("bigint").alias("n_huge"), F.count("*").alias("n_pairs"), F.sum("n").alias("n_counted"))


def q_p6_ids(s, d) -> DataFrame:
    return tokens.encode(fx.table(s, d, "documents"))


def q_p6_decoded(s, d) -> DataFrame:
    return tokens.decode(q_p6_ids(s, d))


def _mixture(s, d) -> mixture.Mixture:
    docs = fx.table(s, d, "documents").select("doc_id", "source", "text")
    sizes = stored(tokens.encode(docs, ("doc_id", "source"), only_counts=True))
    return mixture.mix(sizes, fx.table(s, d, "mix_targets"))


def q_p7_mixture(s, d) -> DataFrame:
    return _mixture(s, d).rows


def q_p7_shares(s, d) -> DataFrame:
    return _mixture(s, d).shares


def q_p7_quotas(s, d) -> DataFrame:
    """The apportionment alone, of documents measured in code points (a column), so that SQL can count the seats too."""
    sizes = fx.table(s, d, "documents").select("doc_id", "source", F.col("n_chars").alias("n_tokens"))
    return mixture.mix(sizes, fx.table(s, d, "mix_targets")).shares.select("source", "n_documents", "available_tokens", "quota_blocks", "capped")


def _scored(s, d) -> DataFrame:
    return safety.score_documents(fx.table(s, d, "documents"), ["doc_id", "source"])


def q_p8_found(s, d) -> DataFrame:
    return _scored(s, d).where(safety.is_case()).select("doc_id")


def q_p8_scores(s, d) -> DataFrame:
    return _scored(s, d).drop("source")


def q_p8_rates(s, d) -> DataFrame:
    return safety.rates(_scored(s, d))


def queries() -> dict:
    return {
        "p2_found": q_p2_found,
        "p2_ranked": q_p2_ranked,
        "p2_skipped": q_p2_skipped,
        "p3_found": q_p3_found,
        "p3_neighbors": q_p3_neighbors,
        "p4_found": q_p4_found,
        "p4_group_sizes": q_p4_sizes,
        "p5_found": q_p5_found,
        "p5_pairs": q_p5_pairs,
        "p5_split_baskets": q_p5_huge,
        "p6_ids": q_p6_ids,
        "p6_decoded": q_p6_decoded,
        "p7_mixture": q_p7_mixture,
        "p7_shares": q_p7_shares,
        "p7_quotas": q_p7_quotas,
        "p8_found": q_p8_found,
        "p8_scores": q_p8_scores,
        "p8_rates": q_p8_rates,
    }


_VALID = """valid AS (SELECT edge_id, src, dst, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC) AS rn FROM weighted_edges)
  WHERE rn = 1 AND src IN (SELECT id FROM vertices) AND dst IN (SELECT id FROM vertices))"""
_BEST = f"""WITH {_VALID}, scored AS (SELECT dst, src, max(weight) AS weight FROM valid WHERE weight IS NOT NULL GROUP BY dst, src),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS INT) AS rank FROM scored)
SELECT {{}} FROM ranked WHERE rank <= {N_BEST}"""
_USABLE = f"""state AS (SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iter DESC) AS rn FROM vertex_state) WHERE rn = 1),
usable AS (SELECT id, v FROM state WHERE v IS NOT NULL AND len(v) = {DIMS} AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0
  AND len(list_filter(v, lambda x: x <> 0)) > 0)"""
_LINKS = """e AS (SELECT src AS a, dst AS b FROM match_edges WHERE src IN (SELECT id FROM vertices) AND dst IN (SELECT id FROM vertices)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, label) USING KEY (id) AS (SELECT a, a FROM l UNION
  (SELECT l.b, max(r.label) FROM r JOIN l ON l.a = r.id JOIN recurring.r k ON k.id = l.b WHERE r.label > k.label GROUP BY l.b))"""
_BASKETS = """held AS (SELECT DISTINCT src, dst FROM basket_edges WHERE src IN (SELECT id FROM vertices) AND dst IN (SELECT id FROM items)),
c AS (SELECT dst, count(*) AS c FROM held GROUP BY dst), n AS (SELECT count(DISTINCT src) AS n FROM held),
p AS (SELECT x.dst AS item_a, y.dst AS item_b, count(*) AS n_both FROM held x JOIN held y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2),
q AS (SELECT item_a, item_b, n_both, a.c AS n_a, b.c AS n_b, n AS n_baskets FROM p JOIN c a ON a.dst = item_a JOIN c b ON b.dst = item_b CROSS JOIN n)"""


def oracle_sql() -> dict:
    return {
        "p2_found": _BEST.format("dst, src"),
        "p2_ranked": _BEST.format("dst, src, weight, rank"),
        "p3_found": f"""WITH {_USABLE}, u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM usable),
sims AS (SELECT a.id, b.id AS other, round(list_dot_product(a.v, b.v), 12) AS s FROM u a JOIN u b ON a.id <> b.id),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS r FROM sims WHERE s >= {MIN_COSINE})
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM top WHERE r <= {N_BEST}""",
        "p4_found": f"WITH RECURSIVE {_LINKS} SELECT id, label FROM r",
        "p4_group_sizes": f"WITH RECURSIVE {_LINKS} SELECT label, count(*) AS n FROM r GROUP BY label",
        "p5_found": f"WITH {_BASKETS} SELECT item_a, item_b FROM q WHERE n_both >= 5 AND n_both * 1000 >= n_baskets * 5 AND n_both * n_baskets >= 3 * n_a * n_b",
        "p5_pairs": f"WITH {_BASKETS} SELECT *, round(n_both::DOUBLE * n_baskets / (n_a * n_b), 6) AS lift FROM q",
        "p5_split_baskets": f"""WITH {_BASKETS}, b AS (SELECT src, count(*) AS c FROM held GROUP BY src) SELECT (SELECT count(*) FROM b WHERE c > {isqrt(together.UNIT_PAIRS)}) AS n_huge,
  count(*) AS n_pairs, CAST(sum(n_both) AS BIGINT) AS n_counted FROM p""",
        "p7_quotas": rf"""WITH named AS (SELECT n_chars, lower(regexp_replace(regexp_replace(source, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[\s_\-./]+', '-', 'g')) AS source FROM documents WHERE n_chars > 0),
t AS (SELECT m.source, target_share AS u, max_repeats AS r, count(n_chars) AS n_documents, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS t FROM mix_targets m LEFT JOIN named n ON n.source = m.source GROUP BY ALL),
w AS (SELECT sum(u) AS w, sum(t) AS there FROM t WHERE t > 0),
total AS (SELECT greatest(CAST(floor(min(t * r / (u / w))) AS BIGINT), CAST(floor({mixture.LEAST_FILL} * any_value(there)) AS BIGINT)) // {mixture.BLOCK_TOKENS} AS seats FROM t, w WHERE t > 0),
c AS (SELECT source, u, (t * r + {mixture.BLOCK_TOKENS - 1}) // {mixture.BLOCK_TOKENS} AS cap FROM t WHERE t > 0),
q AS (SELECT source, n, row_number() OVER (ORDER BY u / (2 * n + 1) DESC, source) AS k FROM (SELECT source, u, unnest(range(CAST(cap AS BIGINT))) AS n FROM c)),
s AS (SELECT source, count(*) AS quota FROM q, total WHERE k <= seats GROUP BY source)
SELECT t.source, n_documents, t AS available_tokens, coalesce(quota, 0) AS quota_blocks, coalesce(quota = cap, false) AS capped FROM t LEFT JOIN s USING (source) LEFT JOIN c USING (source)""",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
