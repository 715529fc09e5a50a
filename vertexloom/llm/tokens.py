"""Encoding and decoding a corpus with a public byte-level BPE vocabulary, by a table of distinct words.

Words are split in Spark by the vocabulary's pattern, once. Each chunk of documents keeps its words as codes of
its own small dictionary; the dictionaries' rows meet by word, where each distinct word is encoded once, and
the ids go back to their chunk and, by position, into its documents. Encoding a word alone gives the ids it
has in any text, as merges never cross the pattern's pieces and every piece is one piece by itself as well.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.session import ship, stored

#: Default vocabulary: ranks of byte_bpe_50k. The path is a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The vocabulary's splitting pattern, with white space spelt out (Unicode White_Space), since
# the \s of Java means ASCII only.
_WS = r"\t-\r \x85\xA0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def words(text: str | Column) -> Column:
    """The words of a text, in order; concatenated they are the text. Null gives an empty array."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(PATTERN), F.lit(0))


class Vocabulary:
    """Ranks read once on the driver (half a megabyte, fixed) and sent to the workers."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY):
        ship(spark)
        with open(path, "rb") as f:
            self._data = spark.sparkContext.broadcast(f.read())

    def __getstate__(self):
        return {"_data": self._data}

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self._data.value.splitlines()) if a}

    def encoder(self):
        import tiktoken

        # The words come split; a pattern that takes everything leaves each whole.
        return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks(), special_tokens={}).encode_ordinary


def _coded(src: DataFrame, held: list[str], words_at: str) -> DataFrame:
    """Two kinds of rows, written: of each document ``chunk``, the held columns and ``codes`` of its words; of each
    distinct word of a chunk ``chunk, code, word``. A chunk is one Arrow batch, so its size is bounded by the
    session's limits for these."""
    kinds = dict(src.dtypes)
    schema = "chunk bigint, " + "".join(f"`{h}` {kinds[h]}, " for h in held) + "codes array<int>, code int, word string"
    names = ["chunk", *held, "codes", "code", "word"]

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, b in enumerate(batches):
            lists = b.column(b.num_columns - 1)
            bounds = lists.offsets.to_numpy()
            coded = pc.dictionary_encode(lists.flatten())
            codes = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), coded.indices)
            own, n = coded.dictionary, len(coded.dictionary)
            chunk = lambda m, k=k: pa.array(np.full(m, first + k))
            yield pa.RecordBatch.from_arrays([chunk(b.num_rows), *b.columns[:-1], codes, pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.string())], names=names)
            if n:
                empty = [pa.nulls(n, c.type) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([chunk(n), *empty, pa.nulls(n, codes.type), pa.array(np.arange(n, dtype=np.int32)), own.cast(pa.string())], names=names)

    return stored(src.select(*held, words_at).mapInArrow(run, schema))


def encode_words(asked: DataFrame, vocabulary: Vocabulary, only_counts: bool = False) -> DataFrame:
    """``chunk, code, ids`` (or ``n``, their number) for rows ``chunk, code, word``.

    The rows of a word meet in one task, in order, which encodes the word once, however many chunks ask; a
    frequent word has one row a chunk.
    """
    out, kind = ("n", "int") if only_counts else ("ids", "array<int>")

    def run(batches):
        enc, last, last_ids = vocabulary.encoder(), None, []
        for b in batches:
            word = pc.dictionary_encode(b.column(2))
            own = word.dictionary.to_pylist()
            ids = [last_ids if w == last else enc(w) for w in own]
            if own:
                last, last_ids = own[-1], ids[-1]
            table = pa.array([len(x) for x in ids], pa.int32()) if only_counts else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), table.take(word.indices)], names=["chunk", "code", out])

    return asked.repartition("word").sortWithinPartitions("word").select("chunk", "code", "word").mapInArrow(run, f"chunk bigint, code int, {out} {kind}")


def _flat(column) -> pa.Array:
    c = column.combine_chunks()
    return c if isinstance(c, pa.Array) else c.chunk(0) if c.num_chunks else pa.array([], c.type)


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: Vocabulary | None = None, only_counts: bool = False) -> DataFrame:
    """The ``keep`` columns and ``ids`` (or ``n_tokens``) of every row of ``docs``; null and empty texts
    have no ids.

    Rows that agree in ``keep`` are rows of their own. There is one way at every size: texts are split once and
    never shuffled; what is shuffled are the distinct words of each chunk and the documents' codes, and nothing
    but the vocabulary itself passes through the driver.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or Vocabulary(spark)
    held = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, held)], words(text).alias("_w"))
    out, kind = ("n_tokens", "bigint") if only_counts else ("ids", "array<int>")
    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep) + f", {out} {kind}"
    names = [*keep, out]
    coded = _coded(src, held, "_w")
    answered = encode_words(coded.where("word IS NOT NULL").select("chunk", "code", "word"), vocabulary, only_counts)
    own = coded.where("word IS NULL").select("chunk", *held, "codes")

    def meet(rows: pa.Table, answers: pa.Table) -> pa.Table:
        lists, code, value = _flat(rows.column("codes")), _flat(answers.column("code")).to_numpy(), _flat(answers.column(2))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        at = lists.flatten().to_numpy()
        bounds = bounds - bounds[0]
        if len(code) != (at.max() + 1 if len(at) else 0):
            raise ValueError("a word has no answer")
        place = np.empty(len(code), np.int64)
        place[code] = np.arange(len(code))
        if only_counts:
            each = value.to_numpy().astype(np.int64)
        else:
            offsets = value.offsets.to_numpy().astype(np.int64)
            each, flat, start = np.diff(offsets), value.flatten().to_numpy(), offsets[:-1] - offsets[0]
        n = each[place[at]] if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        if only_counts:
            got = pa.array(ends[bounds[1:]] - ends[bounds[:-1]], pa.int64())
        else:
            ids = flat[np.repeat(start[place[at]] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else np.zeros(0, np.int32)
            got = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(ids, pa.int32()))
        return pa.Table.from_arrays([*[rows.column(h) for h in held], got], names=names)

    return own.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(meet, schema)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """``key, text``: each id is looked up in the vocabulary's table of pieces (fixed size, one row per id,
    so the join is by array position), and the bytes of a document are joined in order. A null list gives
    null; an id outside the vocabulary raises."""
    vocabulary = vocabulary or Vocabulary(encoded.sparkSession)

    def run(batches):
        ranks = vocabulary.ranks()
        pieces = [b""] * (max(ranks.values()) + 1)
        for p, r in ranks.items():
            pieces[r] = p
        n = np.array([len(p) for p in pieces], np.int64)
        start = np.cumsum(n) - n
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        for b in batches:
            lists = b.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            flat = lists.flatten().to_numpy()
            if len(flat) and (flat.min() < 0 or flat.max() >= len(n)):
                raise ValueError("an id is not in the vocabulary")
            m = n[flat]
            ends = np.concatenate([[0], np.cumsum(m)])
            data = raw[np.repeat(start[flat] - ends[:-1], m) + np.arange(ends[-1])].tobytes()
            at = ends[bounds]
            null = lists.is_null().to_pylist()
            text = [None if z else data[at[i] : at[i + 1]].decode("utf-8", "replace") for i, z in enumerate(null)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, text string")
