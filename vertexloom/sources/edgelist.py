"""Text edge lists: one ``src dst`` record a line, integers in decimal, 0x hex or leading-0 octal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.sources.csc import write_csc


def _integer(t: Column) -> Column:
    neg = t.startswith("-")
    d = F.lower(F.regexp_replace(t, "^[+-]", ""))
    hexa, octal = d.rlike("^0x[0-9a-f]+$"), d.rlike("^0[0-7]+$")
    v = (
        F.when(hexa, F.conv(F.substring(d, 3, 40), 16, 10))
        .when(octal, F.conv(d, 8, 10))
        .when(d.rlike("^(0|[1-9][0-9]*)$"), d)
    )
    v = v.try_cast("bigint")
    return F.when(neg, -v).otherwise(v)


def read_edge_list(spark: SparkSession, path: str, nv: int | None = None, ne: int | None = None, comment: str | None = None) -> Graph:
    """The graph of the file. Blank lines (and lines that start with ``comment``) are skipped; any other
    line that isn't two integers raises, as does a number of records other than ``ne``, when given."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("l")).where(F.col("l") != "")
    if comment:
        lines = lines.where(~F.col("l").startswith(comment))
    t = F.split("l", " ")
    got = lines.select("l", _integer(F.get(t, 0)).alias("src"), _integer(F.get(t, 1)).alias("dst"), F.size(t).alias("n"))
    bad = (F.col("n") != 2) | F.col("src").isNull() | F.col("dst").isNull()
    fail = F.raise_error(F.concat(F.lit("not an edge: "), F.col("l"))).cast("bigint")
    edges = got.select(F.when(bad, fail).otherwise(F.col("src")).alias("src"), F.when(bad, fail).otherwise(F.col("dst")).alias("dst"))
    if ne is not None and (n := edges.count()) != ne:
        raise ValueError(f"{path}: {n} edges, not {ne}")
    return Graph.from_edges(edges, nv)


def write_edge_list(g: Graph, path: str) -> None:
    g.edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)


def convert(spark: SparkSession, source: str, target: str, nv: int | None = None, ne: int | None = None, degree_trailer: bool = True) -> None:
    """Text edge list to binary file, with the out-degree trailer as the offline converter writes it."""
    write_csc(read_edge_list(spark, source, nv, ne), target, degree_trailer)


def edges_frame(df: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """Edges from any frame (any Spark source) by naming its columns."""
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *([F.col(weight).alias("weight")] if weight else []))
