"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is a slice of a partition.  Its suffix array holds every word position whose suffix
can match a test suffix for as long as the shortest window, which a filter over the test
set's neighbouring word pairs decides, sorted by the words that follow.  Every test suffix
is looked up by binary search; the equal range gives all locations of its window, and
locations on one diagonal join to the longest verbatim matches.

The documents are never shuffled.  The benchmark's words are broadcast in blocks of at most
``block_bytes`` of text: a larger benchmark is split by a hash of its rows and the documents
go through one block after the other.

Words: A-Z lower-cased, then runs of letters a-z, digits and non-ASCII characters.  A window
is ``size`` consecutive words of an item; an item of fewer, but not none, is one window.

Defined results: null and empty texts and items have no words and match nothing; repeated
items with one id count once, an item with a null id hits words but is not listed; a null
document id passes through; repeated rows have equal results; an empty benchmark hits
nothing.  Further columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbin.llm import textscan as scan
from flowbin.llm.frames import pack, settle

SIZE = 10
BLOCK_BYTES = 16 << 20
_NO_ITEM = np.iinfo(np.int64).min
_BITS = 22
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_MATCHES = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("item", "item_first", "first", "n_words")]))


def _words(column) -> scan.Words:
    data, off = scan.buffers(column)
    return scan.words(scan.LOWER[data], off, scan.NON_WORD)


def _pairs(h: np.ndarray) -> np.ndarray:
    return (scan.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:], 31) >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class TestSet:
    """The words of a block of items, its windows, and the filter over word pairs."""

    h: np.ndarray  # word hashes
    at: np.ndarray  # first word of each distinct window
    size: np.ndarray  # its words
    check: np.ndarray  # its second hash
    uses: np.ndarray  # offsets into use_* by window (n + 1)
    use_item: np.ndarray
    use_first: np.ndarray
    least: int
    pair: np.ndarray  # filter bits
    one: np.ndarray  # sorted distinct first words

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None], size: int) -> TestSet:
        w = _words(pa.array(texts, pa.string()))
        h, h2 = w.hashes(), w.hashes(1)
        counts = w.counts
        long = scan.windows(w, h, size)[0]
        short = w.first[:-1][(counts > 0) & (counts < size)]
        at = np.concatenate([long, short])
        width = np.concatenate([np.full(len(long), size), counts[(counts > 0) & (counts < size)]])
        key, check = scan.span_hash(h, at, at + width), scan.span_hash(h2, at, at + width, 1)
        order = np.lexsort((at, check, key, width))
        at, width, key, check = at[order], width[order], key[order], check[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (width[1:] != width[:-1])
        row = w.row
        items = np.array([_NO_ITEM if i is None else i for i in ids], np.int64)
        pair = np.zeros(1 << _BITS, bool)
        inner = np.flatnonzero(row[:-1] == row[1:])
        if len(h) > 1:
            pair[_pairs(h)[inner]] = True
        return cls(h, at[new], width[new], check[new], np.append(np.flatnonzero(new), len(at)), items[row[at]],
                   at - w.first[:-1][row[at]], int(width.min()) if len(width) else 0, pair, np.unique(h[at]))


def suffix_array(h: np.ndarray, end: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` sorted by their next ``depth`` words; a row's end sorts first."""
    return at[np.lexsort([_column(h, end, at, c) for c in range(depth - 1, -1, -1)])]


def _column(h: np.ndarray, end: np.ndarray, at: np.ndarray, c: int) -> np.ndarray:
    """The word ``c`` places after each position, 0 after the end of its row."""
    to = np.minimum(at + c, len(h) - 1)
    return np.where(at + c < end[at], h[to], np.uint64(0))


def _bisect(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each key in its own sorted range of values."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        v = values[np.minimum(mid, len(values) - 1)]
        up = open_ & ((v <= key) if right else (v < key))
        lo[up] = mid[up] + 1
        down = open_ & ~up
        hi[down] = mid[down]
    return lo


def locate(sa: np.ndarray, h: np.ndarray, end: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range of the suffix array that begins with each test window: window, from, to."""
    win = np.arange(len(test.at))
    lo, hi = np.zeros(len(win), np.int64), np.full(len(win), len(sa))
    for c in range(int(test.size.max())):
        on = c < test.size[win]
        values = _column(h, end, sa, c)
        key = test.h[test.at[win[on]] + c]
        a, b = _bisect(values, lo[on], hi[on], key, False), _bisect(values, lo[on], hi[on], key, True)
        lo[on], hi[on] = a, b
        some = lo < hi
        win, lo, hi = win[some], lo[some], hi[some]
        if len(win) == 0:
            break
    return win, lo, hi


def search(w: scan.Words, test: TestSet, size: int):
    """All places of test windows in a shard: word position, window; by suffix array."""
    none = np.zeros(0, np.int64)
    n = len(w.start)
    if n == 0 or len(test.at) == 0:
        return none, none
    h, row = w.hashes(), w.row
    end = w.first[1:][row]
    if test.least == 1:
        slot = np.minimum(np.searchsorted(test.one, h), len(test.one) - 1)
        at = np.flatnonzero(test.one[slot] == h)
    else:
        good = np.zeros(n, np.int64)
        good[:-1] = test.pair[_pairs(h)]
        run = np.concatenate([[0], np.cumsum(good)])
        at = np.arange(n - test.least + 1)
        at = at[(run[at + test.least - 1] - run[at] == test.least - 1) & (at + test.least <= end[at])]
    if len(at) == 0:
        return none, none
    sa = suffix_array(h, end, at, int(test.size.max()))
    win, lo, hi = locate(sa, h, end, test)
    if len(win) == 0:
        return none, none
    n_each = hi - lo
    place = sa[np.repeat(lo, n_each) + np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)]
    win = np.repeat(win, n_each)
    same = scan.span_hash(w.hashes(1), place, place + test.size[win], 1) == test.check[win]
    return place[same], win[same]


def longest(row: np.ndarray, place: np.ndarray, win: np.ndarray, test: TestSet):
    """Join the windows' places to maximal matches: row, item, item_first, place, n_words."""
    n_each = (test.uses[1:] - test.uses[:-1])[win]
    use = np.repeat(test.uses[win], n_each) + np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)
    row, place, size = np.repeat(row, n_each), np.repeat(place, n_each), np.repeat(test.size[win], n_each)
    item, first = test.use_item[use], test.use_first[use]
    order = np.lexsort((place, place - first, item, row))
    row, item, first, place, size = row[order], item[order], first[order], place[order], size[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - first[1:] != place[:-1] - first[:-1]) | (place[1:] - place[:-1] > 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    return row[head], item[head], first[head], place[head], (place[last] + size[last] - place[head]) if len(head) else head


def _structs(rows: int, of: np.ndarray, **columns: np.ndarray) -> pa.ListArray:
    """Lists by row from values sorted by row."""
    values = pa.StructArray.from_arrays([pa.array(v, pa.int64(), mask=(v == _NO_ITEM)) for v in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)), pa.int32()), values)


def _earlier(column: pa.Array, names: tuple[str, ...]):
    """Row and fields of a list<struct> column."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    fields = [flat.field(c).fill_null(_NO_ITEM).to_numpy(zero_copy_only=False) for c in names]
    return np.repeat(np.arange(len(size)), size), *fields


def _pass(shared, size: int, schema: pa.Schema):
    """One block of items against the documents; adds to the matches and spans found before."""

    def run(batches):
        test: TestSet = shared.value
        for b in scan.slices(batches, "text"):
            w = _words(b.column("text"))
            place, win = search(w, test, size)
            row, item, item_first, first, n = longest(w.row[place], place, win, test)
            first = first - w.first[row]
            old = _earlier(b.column("matches"), ("item", "item_first", "first", "n_words"))
            row, item, item_first, first, n = (np.concatenate(x) for x in zip(old, (row, item, item_first, first, n), strict=True))
            order = np.lexsort((item_first, item, first, row))
            row, item, item_first, first, n = row[order], item[order], item_first[order], first[order], n[order]
            matches = _structs(b.num_rows, row, item=item, item_first=item_first, first=first, n_words=n)
            edge = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(edge, w.first[row] + first, 1)
            np.add.at(edge, w.first[row] + first + n, -1)
            spans = scan.spans(w, np.cumsum(edge[:-1]) > 0)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text"), b.column("rest"), pa.array(w.counts, pa.int64()), matches, spans], schema=schema)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` and a struct ``leaks``: n_words, n_hit, items (distinct, ascending), spans of
    hit words [first, last), and the longest verbatim matches with their place in both texts."""
    spark = docs.sparkSession
    packed = pack(docs, id_col, text_col, "leaks")
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = T.StructType([*packed.rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("matches", _MATCHES), T.StructField("spans", _SPANS)])
    frame = packed.rows.withColumn("matches", F.lit(None).cast(_MATCHES))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).distinct().collect()
        shared = spark.sparkContext.broadcast(TestSet.of([r.item for r in own], [r.text for r in own], size))
        frame = frame.select("id", "text", "rest", "matches").mapInArrow(_pass(shared, size, to_arrow_schema(out)), out)
        if k + 1 < blocks:  # one block of items in memory at a time
            frame = settle(frame)
            shared.unpersist()
    listed = F.array_sort(F.array_distinct(F.transform(F.filter("matches", lambda m: m["item"].isNotNull()), lambda m: m["item"])))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return packed.unpack(frame, F.struct("n_words", n_hit.alias("n_hit"), listed.alias("items"), "spans", "matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    return find_leaks(docs, benchmark, **options).where("leaks.n_hit = 0").drop("leaks")
