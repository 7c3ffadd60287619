"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, drawn from its code point by a hash.  An
n-gram is bound from its letters' vectors, each permuted (rotated) by its place, and a
text is the bundle (sum) of its n-grams.  A language's prototype is the bundle of its training
texts, each weighed by one over its number of n-grams.  A text gets the language of the prototype with
the greatest cosine (of equals the first by name), which is also its score.

Texts are lower-cased and everything but letters is one space; a space goes before and after.

Training sums n-gram counts by language and dimension in the tasks; what is shuffled and
collected is one vector for each language and task.

Defined results: a null text or one without letters is ``und`` with score 0; documents with
a null language or text teach nothing; without any teaching document all are ``und``;
a negative cosine scores 0; repeated rows have equal results.  Further columns pass through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbin.llm import textscan as scan
from flowbin.llm.frames import pack, settle

DIM = 1024
N = 3
BLOCK = 2048  # n-gram vectors made at a time
SCALE = 1 << 20  # prototypes are summed as integers, so that the order of tasks does not matter


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The bits of the letters' random vectors (rows x dim, 0 or 1)."""
    words = scan.mix(points.astype(np.uint64)[:, None] * np.uint64(dim // 64) + np.arange(dim // 64, dtype=np.uint64), 71)
    return np.unpackbits(words.view(np.uint8), axis=1)


def grams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of every text: row, number of the distinct n-gram, count; and its code points."""
    lower = [t.lower() for t in texts]
    size = np.array([len(t) for t in lower], np.int64)
    points = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    points = np.where(_letters()[points], points, 0x20)
    # one space before each text, and runs of spaces shortened to one
    start = np.cumsum(size) - size
    points, row = np.insert(points, start, 0x20), np.insert(row, start, np.arange(len(texts)))
    end = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))
    points, row = np.insert(points, end, 0x20), np.insert(row, end, np.arange(len(texts)))
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == 0x20) & (points[:-1] == 0x20) & (row[1:] == row[:-1])
    points, row = points[~again], row[~again]
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
    key = np.zeros(len(at), np.uint64)
    for j in range(n):
        key = key * np.uint64(0x110000) + points[at + j].astype(np.uint64)  # three code points fit in 63 bits
    kind, number = np.unique(key, return_inverse=True)
    pair, count = np.unique(row[at] * max(len(kind), 1) + number, return_counts=True)
    which = np.zeros((len(kind), n), np.int64)
    for j in range(n - 1, -1, -1):
        which[:, j] = (kind % np.uint64(0x110000)).astype(np.int64)
        kind = kind // np.uint64(0x110000)
    return pair // max(len(which), 1), pair % max(len(which), 1), count, which


def bound(which: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Vectors of n-grams: the product of the letters' signs, letter j rotated by j places."""
    letters, number = np.unique(which, return_inverse=True)
    bits = vectors(letters, dim)
    number = number.reshape(which.shape)
    out = np.zeros((len(which), dim), np.uint8)
    for j in range(which.shape[1]):
        out ^= np.roll(bits, j, axis=1)[number[:, j]]
    return out


def bundle(n_rows: int, row: np.ndarray, number: np.ndarray, weight: np.ndarray, which: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Weighted sums of n-gram vectors by row (rows x dim)."""
    total = np.zeros((n_rows, dim), np.float32)
    order = np.argsort(number, kind="stable")
    row, number, weight = row[order], number[order], weight[order].astype(np.float32)
    for begin in range(0, len(which), BLOCK):
        signs = 1.0 - 2.0 * bound(which[begin : begin + BLOCK], dim).astype(np.float32)
        a, b = np.searchsorted(number, [begin, begin + BLOCK])
        table = np.zeros((n_rows, len(signs)), np.float32)
        np.add.at(table, (row[a:b], number[a:b] - begin), weight[a:b])
        total += table @ signs
    return total


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram counts without the empty n-gram, and the number of n-grams of each text (0: no letter)."""
    row, number, count, which = grams(texts)
    if len(which):
        some = ~(which == 0x20).all(1)[number]
        row, number, count = row[some], number[some], count[some]
    return row, number, count, which, np.bincount(row, weights=count, minlength=len(texts))


def _slices(batches):
    return scan.slices(batches, "text", 256 << 10)


def _learn(dim: int, schema: pa.Schema):
    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in _slices(batches):
            lang = b.column("lang").to_pylist()
            row, number, count, which, n = counted(b.column("text").to_pylist())
            names = sorted(set(lang))
            of = np.array([names.index(x) for x in lang], np.int64)
            total = bundle(len(names), of[row], number, count / np.maximum(n, 1)[row], which, dim)
            for name, value in zip(names, total, strict=True):
                if value.any():
                    held[name] = held.get(name, 0) + np.rint(value * SCALE).astype(np.int64)
        if held:
            names = [x for x in held for _ in range(dim)]
            place = np.tile(np.arange(dim), len(held))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(place, pa.int32()), pa.array(np.concatenate(list(held.values())), pa.int64())], schema=schema)

    return run


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM) -> DataFrame:
    """(lang, proto): the prototype of each language as an array of ``dim`` longs."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    out = T.StructType([T.StructField("lang", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("value", T.LongType())])
    parts = rows.mapInArrow(_learn(dim, to_arrow_schema(out)), out)
    summed = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
    return summed.groupBy("lang").agg(listed.alias("proto"))


def _predict(shared, dim: int, schema: pa.Schema):
    def run(batches):
        names, proto = shared.value
        unit = proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9) if len(names) else proto
        for b in _slices(batches):
            row, number, count, which, n = counted(["" if x is None else x for x in b.column("text").to_pylist()])
            if names:
                total = bundle(b.num_rows, row, number, count, which, dim)
                cosine = (total @ unit.T.astype(np.float32)) / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
                best = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
                lang = [names[k] if c else "und" for k, c in zip(best, n, strict=True)]
                score = np.where(n > 0, score, 0.0)
            else:
                lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), b.column("rest"), pa.array(lang, pa.string()), pa.array(score)], schema=schema)

    return run


def predict(docs: DataFrame, prototypes: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, most_languages: int = 5_000) -> DataFrame:
    """``docs`` with a struct ``language``: lang and score.

    The prototypes are broadcast: 8 KB a language, and ValueError beyond ``most_languages``.
    """
    protos = settle(prototypes)
    if protos.count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    known = sorted((r.lang, r.proto) for r in protos.collect())
    shared = docs.sparkSession.sparkContext.broadcast(([k for k, _ in known], np.array([p for _, p in known], np.float64).reshape(len(known), dim)))
    packed = pack(docs, id_col, text_col, "language")
    out = T.StructType([*packed.rows.schema.fields, T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return packed.unpack(packed.rows.mapInArrow(_predict(shared, dim, to_arrow_schema(out)), out), F.struct("lang", "score"))


def bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % modulus
