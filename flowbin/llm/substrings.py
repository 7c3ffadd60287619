"""Substring dedup by recompression.

A window is ``size`` consecutive words of one document.  A word is removed if some window
over it has a word sequence that also starts in a document with a smaller id; windows are
judged on the input.  Two documents with the same id never remove from each other.

Steps, all of them joins and aggregates on narrow rows:

1. Exact copies of a text are found by digest; they take no part in the search.
2. Every document is parsed by recompression (:mod:`flowbin.llm.recompress`) and gives its
   anchors, high-level symbols that equal windows share.  An anchor that occurs in one
   document only cannot belong to a repeat.
3. The windows on anchors of two documents or more are verified: grouped by 96 bits of two
   hashes of their words, they learn the smallest document.
4. Each document removes the words under its windows that start in a smaller one.

A key that many documents share is combined before the shuffle: each slice of documents
sends one row under it, whatever the number of its documents, and decides the others itself.

Defined results: a null or empty text has no words and comes back unchanged; a text of
fewer than ``size`` words has no windows; a row with a null id is kept whole and removes
nothing; of rows with the same id and different texts each is judged by its own text; equal
rows are equal in the result.  Further columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbin.llm import textscan as scan
from flowbin.llm.frames import pack, settle
from flowbin.llm.recompress import anchors

SIZE = 13
_ANCHORS = "k long, name long, id long, known boolean"
_WINDOWS = "k long, h1 long, h2 int, id long"


def _list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row lengths and flat values of a list<long> column (null: empty)."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, column.flatten().to_numpy(zero_copy_only=False)


def _member(values: np.ndarray, row: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its row."""
    size, flat = _list(column)
    if len(flat) == 0 or len(values) == 0:
        return np.zeros(len(values), bool)
    # one sorted table of (row, value); both packed into a structured key by a salted hash
    key = lambda v, r: scan.mix(v.astype(np.int64).view(np.uint64) ^ scan.mix(r.astype(np.uint64), 21), 22)
    table = np.sort(key(flat, np.repeat(np.arange(len(size)), size)))
    probe = key(values, row)
    at = np.minimum(np.searchsorted(table, probe), len(table) - 1)
    return table[at] == probe


def _scan(batch: pa.RecordBatch) -> scan.Words:
    return scan.words(*scan.buffers(batch.column("text")))


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins (keys sorted)."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _spread(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A key of its own for every key and id."""
    return scan.mix(key ^ scan.mix(ids.view(np.uint64), 23), 24)


def _emit_anchors(size: int):
    """Anchors of two documents of the slice are known to be shared; one row of each stands
    for the slice under the anchor's own key, the others travel under keys of their own."""
    schema = pa.schema([("k", pa.int64()), ("name", pa.int64()), ("id", pa.int64()), ("known", pa.bool_())])

    def run(batches):
        for b in scan.slices(batches, "text"):
            w = _scan(b)
            at, _, name, _ = anchors(w, w.hashes(), size)
            row = w.row[at]
            own = ~b.column("copy").to_numpy(zero_copy_only=False)[row]
            name, ids = name[own], b.column("id").to_numpy(zero_copy_only=False)[row[own]]
            order = np.lexsort((ids, name))
            name, ids = name[order], ids[order]
            new = _heads(name, ids)
            name, ids = name[new], ids[new]
            first = _heads(name)
            count = np.diff(np.append(np.flatnonzero(first), len(name)))
            known = np.repeat(count > 1, count)
            k = np.where(first, name, _spread(name, ids)).view(np.int64)
            yield _batch(schema, k, pa.array(name.view(np.int64), mask=first), ids, known)

    return run


def _emit_windows(size: int):
    """Windows on shared anchors.  Of the slice's documents with a window the least stands for
    it; the others are hit for certain and travel under keys of their own, with h1 set."""
    schema = pa.schema([("k", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("id", pa.int64())])

    def run(batches):
        for b in scan.slices(batches, "text"):
            w = _scan(b)
            h = w.hashes()
            at, whole, name, _ = anchors(w, h, size)
            row = w.row[at]
            pick = _member(name.view(np.int64), row, b.column("names")) & ~b.column("copy").to_numpy(zero_copy_only=False)[row]
            at, whole = at[pick], whole[pick]
            ids = b.column("id").to_numpy(zero_copy_only=False)[row[pick]]
            second = (scan.span_hash(w.hashes(1), at, at + size, 1) >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((ids, second, whole))
            whole, second, ids = whole[order], second[order], ids[order]
            new = _heads(whole, second, ids)
            whole, second, ids = whole[new], second[new], ids[new]
            first = _heads(whole, second)
            k = np.where(first, whole, _spread(whole, ids)).view(np.int64)
            yield _batch(schema, k, pa.array(whole.view(np.int64), mask=first), second.view(np.int32), ids)

    return run


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Words of n that lie under a window starting at one of ``at``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def cut(w: scan.Words, gone: np.ndarray) -> list[str]:
    """Texts without the given words; a word goes with the white space after it."""
    last = np.minimum(np.append(w.start[1:], len(w.data)), np.repeat(w.offsets[1:], w.counts))
    edge = np.zeros(len(w.data) + 1, np.int32)
    np.add.at(edge, w.start[gone], 1)
    np.add.at(edge, last[gone], -1)
    stay = np.cumsum(edge[:-1]) == 0
    kept = w.data[stay]
    off = np.concatenate([[0], np.cumsum(stay)])[w.offsets]
    return [kept[a:b].tobytes().decode("utf-8") for a, b in zip(off[:-1], off[1:], strict=True)]


def _emit_kept(size: int, columns: list[str], schema: pa.Schema):
    def run(batches):
        for b in scan.slices(batches, "text"):
            w = _scan(b)
            h = w.hashes()
            at, whole = scan.windows(w, h, size)
            row = w.row[at]
            hit = _member(whole.view(np.int64), row, b.column("hits")) | b.column("copy").to_numpy(zero_copy_only=False)[row]
            gone = covered(len(h), at[hit], size)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            text = b.column("text")
            if removed.any():
                new = cut(w, gone)
                old = text.to_pylist()
                text = pa.array([n if r else o for n, o, r in zip(new, old, removed, strict=True)], pa.string())
            else:
                text = text.cast(pa.string())
            spans = scan.spans(w, gone)
            out = [text if c == "text" else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), spans], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with repeated windows cut from the text.

    Adds a struct ``repeats`` with n_words and n_removed (long) and spans, the removed word
    ranges [first, last).  A column of that name in the input is replaced.
    """
    packed = pack(docs, id_col, text_col, "repeats")
    rows = packed.rows.withColumn("digest", F.sha2("text", 256))
    known = rows.where(F.col("id").isNotNull())

    # 1: copies of a text with a smaller id
    ids = known.where(F.col("text").isNotNull()).select("id", "digest")
    least = settle(ids.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most"))
    copies = ids.join(least, "digest").where("least < id").groupBy("id").agg(F.collect_set("digest").alias("copies"))
    marked = known.join(copies, "id", "left").select(
        "id", "text", "rest", F.coalesce(F.array_contains("copies", F.col("digest")), F.lit(False)).alias("copy"))

    # 2: anchors of two documents or more
    found = marked.mapInArrow(_emit_anchors(size), _ANCHORS)
    n = F.count("*").over(Window.partitionBy("k"))
    shared = found.withColumn("n", n).where("n > 1 OR known").select("id", F.coalesce("name", "k").alias("name"))
    names = shared.groupBy("id").agg(F.collect_list("name").alias("names"))

    # 3: their windows, verified
    seen = marked.join(names, "id").mapInArrow(_emit_windows(size), _WINDOWS)
    least = F.min("id").over(Window.partitionBy("k", "h2"))
    hits = seen.withColumn("least", least).where("h1 IS NOT NULL OR least < id").select("id", F.coalesce("h1", "k").alias("h1"))
    hits = hits.groupBy("id").agg(F.collect_list("h1").alias("hits"))

    # 4
    rest_type = rows.schema["rest"].dataType
    out = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rest", rest_type),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    ])
    columns = ["id", "text", "rest"]
    kept = marked.join(hits, "id", "left").mapInArrow(_emit_kept(size, columns, to_arrow_schema(out)), out)
    unknown = rows.where(F.col("id").isNull()).select("id", "text", "rest", F.lit(False).alias("copy"), F.lit(None).cast("array<long>").alias("hits"))
    kept = kept.unionByName(unknown.mapInArrow(_emit_kept(size, columns, to_arrow_schema(out)), out))
    return packed.unpack(kept, F.struct("n_words", "n_removed", "spans"))


def word_digest(text) -> F.Column:
    """Lower-case hex SHA-256 of the words of a text joined by one space."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(F.trim(flat), 256)
