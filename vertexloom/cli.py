"""Command line: the four programs and the converter over graph files.

``python -m vertexloom.cli pagerank -file g.csc -ni 10 -output out``; flags as listed by ``--help``.
Results are written as Parquet to ``-output``, or counted if none is given.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from vertexloom.operators.check import check_components, check_sssp
from vertexloom.operators.degree import graph_stats, memory_report
from vertexloom.operators.partition import check_bounds, edge_balanced_bounds
from vertexloom.plans.iterate import Trace
from vertexloom.plans.programs import colfilter, components, pagerank, sssp
from vertexloom.sources.csc import read_csc
from vertexloom.sources.edgelist import convert

PROGRAMS = ("pagerank", "sssp", "components", "colfilter")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vertexloom", allow_abbrev=False)
    sub = p.add_subparsers(dest="program", required=True)
    for name in PROGRAMS:
        q = sub.add_parser(name, allow_abbrev=False)
        q.add_argument("-file", required=True)
        q.add_argument("-output")
        q.add_argument("-ng", "-ll:gpu", dest="num_parts", type=int, default=1, help="partitions of the per-part reports")
        if name in ("pagerank", "colfilter"):
            q.add_argument("-ni", dest="num_iter", type=int, required=True)
        if name == "sssp":
            q.add_argument("-start", type=int, default=0)
        q.add_argument("-verbose", "-v", action="store_true", help="print statistics and the trace of the rounds")
        q.add_argument("-check", "-c", action="store_true", help="check the fixpoint, part by part")
    q = sub.add_parser("converter", allow_abbrev=False)
    q.add_argument("-nv", type=int)
    q.add_argument("-ne", type=int)
    q.add_argument("-input", required=True)
    q.add_argument("-output", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a, _ = parser().parse_known_args(argv)  # unknown flags are left to the runtime
    spark = spark or SparkSession.builder.appName("vertexloom").getOrCreate()
    if a.program == "converter":
        convert(spark, a.input, a.output, a.nv, a.ne)
        return 0
    g = read_csc(spark, a.file, weighted=a.program == "colfilter")
    bounds = None
    if a.verbose:
        graph_stats(g, a.num_parts).show(truncate=False)
        bounds = edge_balanced_bounds(g, a.num_parts)
        check_bounds(bounds, g.nv)
        if a.program != "colfilter":  # there is no report for its vectors
            memory_report(g, bounds, a.program).show(a.num_parts, truncate=False)
    trace, failed, began = Trace(bounds), 0, time.time()
    if a.program == "pagerank":
        out = pagerank(g, a.num_iter)
    elif a.program == "colfilter":
        out = colfilter(g, a.num_iter)
    elif a.program == "sssp":
        out = sssp(g, a.start, trace=trace)
    else:
        out = components(g, trace=trace)
    if a.output:
        out.write.mode("overwrite").parquet(a.output)
        out = spark.read.parquet(a.output)
    else:
        print(f"rows: {out.count()}")
    print(f"ELAPSED TIME = {time.time() - began:.3f} s")
    if a.verbose and trace.rows:
        trace.frame(spark).show(len(trace.rows), truncate=False)
        trace.part_frame(spark).show(len(trace.part_rows), truncate=False)
    if a.check and a.program in ("sssp", "components"):
        run = check_sssp if a.program == "sssp" else check_components
        for r in run(g, out, bounds if bounds is not None else edge_balanced_bounds(g, a.num_parts)).orderBy("part").collect():
            print(f"[{'PASS' if r.passed else 'FAIL'}] part {r.part}: {r.mistakes} mistakes")
            failed += not r.passed
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
