"""The binary compressed-sparse-column graph file.

Little-endian, unpadded: nv u32, ne u64, nv end offsets u64 (the in-edges of vertex i end there, those of
vertex 0 start at 0), ne source ids u32 grouped by target, then, if weighted, ne weights i32; a writer
may add the nv out-degrees u32 as a trailer. The file says neither whether it is weighted nor whether it
has a trailer, so ``weighted`` is an option of the reader and never guessed.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vertexloom.graph import Graph
from vertexloom.operators.degree import out_degree
from vertexloom.operators.index import csc_offsets
from vertexloom.session import cut, ship
from vertexloom.sources.paths import arrow_file, hadoop, is_local, local_path, make_parent

HEADER = 12
#: Edges of one input partition, and of one Arrow batch.
EDGES_PER_PARTITION = 8_000_000
EDGES_PER_BATCH = 262_144


def read_header(path: str, weighted: bool = False) -> tuple[int, int]:
    """(nv, ne); ValueError if the size of the file fits neither layout."""
    with arrow_file(path) as f:
        size, head = f.size(), f.read(HEADER)
    if len(head) < HEADER:
        raise ValueError(f"{path}: no header")
    nv, ne = struct.unpack("<IQ", head)
    if ne >= 2**63:
        raise ValueError(f"{path}: too many edges")
    body = HEADER + 8 * nv + (8 if weighted else 4) * ne
    allowed = {body, body + 4 * nv} | ({body + 4 * ne} if not weighted else set())
    if size not in allowed:
        raise ValueError(f"{path}: {size} bytes; nv={nv}, ne={ne}{', weighted' if weighted else ''} needs one of {sorted(allowed)}")
    return nv, ne


class _Edges(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CscReader(DataSourceReader):
    """Partitions are equal ranges of edges, so one target with most of the edges is read by many tasks.

    A task finds its first target by bisection in the offsets on disk and reads only its own slices.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.weighted = str(options.get("weighted", "false")).lower() == "true"
        self.per = int(options.get("edgesPerPartition", EDGES_PER_PARTITION))
        self.nv, self.ne = read_header(self.path, self.weighted)

    def partitions(self):
        return [_Edges(a, min(a + self.per, self.ne)) for a in range(0, self.ne, self.per)] or [_Edges(0, 0)]

    def read(self, part):
        names = ["src", "dst"] + (["weight"] if self.weighted else [])
        with arrow_file(self.path) as f:

            def items(kind: str, at: int, n: int) -> np.ndarray:
                f.seek(at)
                got = np.frombuffer(f.read(n * np.dtype(kind).itemsize), dtype=kind)
                if len(got) != n:
                    raise ValueError(f"{self.path}: file ends early")
                return got

            end = lambda v: int(items("<u8", HEADER + 8 * v, 1)[0])
            if self.nv and end(self.nv - 1) != self.ne:
                raise ValueError(f"{self.path}: the last offset isn't the number of edges")
            sources = HEADER + 8 * self.nv
            for a in range(part.first, part.last, EDGES_PER_BATCH):
                b = min(a + EDGES_PER_BATCH, part.last)
                low, high = 0, self.nv - 1  # first vertex whose block ends after edge a
                while low < high:
                    mid = (low + high) // 2
                    low, high = (low, mid) if end(mid) > a else (mid + 1, high)
                ids, counts, at, v = [], [], a, low
                while at < b:
                    ends = items("<u8", HEADER + 8 * v, min(65_536, self.nv - v)).astype(np.int64)
                    if len(ends) == 0 or (np.diff(ends) < 0).any():
                        raise ValueError(f"{self.path}: offsets decrease or end early")
                    ends = np.minimum(ends, b)
                    n = np.diff(np.concatenate([[at], np.maximum(ends, at)]))
                    ids.append(np.arange(v, v + len(ends)))
                    counts.append(n)
                    at, v = max(at, int(ends[-1])), v + len(ends)
                dst = np.repeat(np.concatenate(ids), np.concatenate(counts))
                src = items("<u4", sources + 4 * a, b - a).astype(np.int64)
                cols = [pa.array(src), pa.array(dst)]
                if self.weighted:
                    cols.append(pa.array(items("<i4", sources + 4 * self.ne + 4 * a, b - a)))
                yield pa.RecordBatch.from_arrays(cols, names=names)


class CscSource(DataSource):
    """``spark.read.format("csc").option("weighted", …).load(path)``."""

    @classmethod
    def name(cls):
        return "csc"

    def schema(self):
        weighted = str(self.options.get("weighted", "false")).lower() == "true"
        return "src bigint, dst bigint" + (", weight int" if weighted else "")

    def reader(self, schema):
        return CscReader(dict(self.options))


def read_csc(spark: SparkSession, path: str, weighted: bool = False, edges_per_partition: int = EDGES_PER_PARTITION, check: bool = True) -> Graph:
    """The graph in ``path``; ``check`` also tests that the sources are vertices (one scan)."""
    ship(spark)
    spark.dataSource.register(CscSource)
    nv, _ = read_header(path, weighted)
    edges = spark.read.format("csc").option("weighted", str(weighted).lower()).option("edgesPerPartition", edges_per_partition).load(path)
    return Graph.from_edges(edges, nv, weighted, check=check)


def read_trailer(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """``id, out_degree`` from the trailer; ValueError if the file has none."""
    ship(spark)
    nv, ne = read_header(path, weighted)
    at = HEADER + 8 * nv + (8 if weighted else 4) * ne
    with arrow_file(path) as f:
        if f.size() != at + 4 * nv:
            raise ValueError(f"{path}: no trailer")

    def read(batches):
        with arrow_file(path) as f:
            for b in batches:  # ids of a range come in order, without gaps
                if b.num_rows:
                    f.seek(at + 4 * b.column(0)[0].as_py())
                    got = np.frombuffer(f.read(4 * b.num_rows), "<u4").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["id", "out_degree"])

    return spark.range(nv).mapInArrow(read, "id bigint, out_degree bigint")


def _write_slices(df: DataFrame, path: str, pieces: list[tuple[str, str, int]]) -> None:
    """Each partition of ``df`` (cut, in file order) writes its rows of each (column, dtype, file offset).

    The place of a partition follows from the row counts of those before it: one number a partition on
    the driver. Writing the same bytes again at the same place is harmless, so a retried task is too.
    """
    counts = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()}
    before, at = {}, 0
    for p in sorted(counts):
        before[p] = at
        at += counts[p]

    def write(batches):
        from pyspark import TaskContext

        row = before.get(TaskContext.get().partitionId(), 0)
        fd = os.open(path, os.O_WRONLY)
        n = 0
        for b in batches:
            for name, kind, offset in pieces:
                data = b.column(name).to_numpy(zero_copy_only=False).astype(kind)
                os.pwrite(fd, data.tobytes(), offset + row * np.dtype(kind).itemsize)
            row += b.num_rows
            n += b.num_rows
        os.close(fd)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    df.mapInArrow(write, "n bigint").agg(F.sum("n")).first()


def _chunks(df: DataFrame, pieces: list[str], kind: str) -> list[DataFrame]:
    """For each column of ``pieces`` the rows' bytes, a few megabytes a row, in the order of ``df``."""

    def pack(name):
        def run(batches):
            for b in batches:
                data = b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([data.tobytes()], pa.binary())], names=["bytes"])

        return run

    return [df.select(name).mapInArrow(pack(name), "bytes binary") for name in pieces]


def _write_stream(spark: SparkSession, path: str, head: bytes, parts: list[DataFrame]) -> None:
    """One file through Hadoop's stream, for file systems in which tasks cannot write at an offset of one file:
    the driver holds a partition of bytes at a time and keeps none."""
    system, p = hadoop(spark, path)
    out = system.create(p, True)
    try:
        out.write(bytearray(head))
        for df in parts:
            for row in df.toLocalIterator():
                out.write(bytearray(row[0]))
    finally:
        out.close()


def write_csc(g: Graph, path: str, degree_trailer: bool = False) -> None:
    """Write the graph; edges are sorted by (dst, src[, weight]) by a distributed range sort.

    On a POSIX file system that all executors share, tasks write their slices in place and nothing passes
    through the driver but a count for each partition. On any other Hadoop file system (which appends only)
    the slices stream through the driver, partition after partition.
    """
    if g.nv >= 2**32:
        raise ValueError("the format holds at most 2**32 - 1 vertices")
    spark = g.spark
    ship(spark)
    edges = cut(g.edges.orderBy("dst", "src", *(["weight"] if g.weighted else [])))
    ne = edges.count()
    width = 8 if g.weighted else 4
    body = HEADER + 8 * g.nv + width * ne
    sources = HEADER + 8 * g.nv
    head = struct.pack("<IQ", g.nv, ne)
    laid = Graph(edges, g.nv)
    ends = csc_offsets(laid).select("id", "in_end").orderBy("id") if g.nv else None
    degrees = out_degree(laid).orderBy("id") if g.nv and degree_trailer else None
    make_parent(spark, path)
    if not is_local(path):
        parts = _chunks(cut(ends), ["in_end"], "<u8") if g.nv else []
        parts += _chunks(edges, ["src"], "<u4") + (_chunks(edges, ["weight"], "<i4") if g.weighted else [])
        _write_stream(spark, path, head, parts + (_chunks(cut(degrees), ["out_degree"], "<u4") if degrees is not None else []))
        return
    path = local_path(path)
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(body + (4 * g.nv if degree_trailer else 0))
    if ne:
        _write_slices(edges, path, [("src", "<u4", sources)] + ([("weight", "<i4", sources + 4 * ne)] if g.weighted else []))
    if g.nv:
        _write_slices(cut(ends), path, [("in_end", "<u8", HEADER)])
    if degrees is not None:
        _write_slices(cut(degrees), path, [("out_degree", "<u4", body)])
