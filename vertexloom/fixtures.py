"""Graphs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.valid import domain, valid_edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchase(spark: SparkSession, sf_dir: str) -> Graph:
    """customer → part, weighted by quantity; vertices are the customers, then the parts."""
    customers = table(spark, sf_dir, "customer").count()
    nv = customers + table(spark, sf_dir, "part").count()
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    e = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("src"), (F.col("l_partkey") + customers).alias("dst"), F.col("l_quantity").cast("int").alias("weight")
    )
    return Graph.from_edges(e, nv, weighted=True, check=False)


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Each order → the customer's next one; vertices are the orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = orders.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where(F.col("dst").isNotNull())
    return Graph.from_edges(e, orders.count(), check=False)


def weighted(spark: SparkSession, sf_dir: str) -> Graph:
    """The valid edges of weighted_edges with a weight, over the ids of vertices."""
    v = table(spark, sf_dir, "vertices")
    known = domain(v)
    e = valid_edges(table(spark, sf_dir, "weighted_edges"), v, known=known).where(F.col("weight").isNotNull())
    return Graph.from_edges(e, known[0], weighted=True, check=False)
