"""Filter interaction audit over documents, duplicates by radix text tries.

Five filters judge every text: A too few words, B too few distinct words, C too many capitals,
D symbols, E equal to the text of a smaller id.  A to D are bits of a mask that a text gets by
itself.  E takes tries:

1. Each task inserts its texts into compressed tries of at most TRIE_BYTES, whose terminals
   hold the least id; the mask is made once a terminal.  Rows above their terminal's least id
   are duplicates already and travel without their text; one row a terminal and part keeps it.
   So a text that fills a third of the table leaves each task once.
2. The remaining texts go to ranges between adaptive prefixes: cuts of a bounded sample by
   bytes, each the shortest prefix that parts its two neighbours.  Where texts share more than
   is sampled, the sample is taken again among them with a longer prefix.
3. Each range inserts its texts in order into compressed tries; a trie is closed at the next
   text after TRIE_BYTES, so a task's memory does not depend on the range.  Traversing the
   terminals gives the flag of each row.

The masks are then reduced to counts by part, mask and label, and these 32 cells a part to the
120 orders of the filters.

Defined results: a null text is empty, and equal to empty ones.  A row without id is no
duplicate and makes none.  Repeated rows (also of one id) count each; a row is a duplicate of
smaller ids only.  A null part is an empty string.  Labels: a document is good (toxic) if any
of its label rows says so; rows without id have none.  Very long texts are one edge of a trie.
An empty table gives no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbin.llm.frames import settle

TRIE_BYTES = 8 << 20    # of text that a trie holds before it is closed
SAMPLE = 20             # sampled texts for each range, SAMPLE_MAX at most
SAMPLE_MAX = 1_000_000
RANGES = 4              # ranges for each shuffle partition
FIRST_PREFIX = 64       # bytes of a sampled text, eight times as many where texts share them
LAST_PREFIX = 64 * 8**4

FILTERS = "ABCDE"
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D.  ``split`` parts at the six ASCII spaces."""
    words = text.split()
    n, distinct = len(words), len(set(words))
    points = len(text.decode("utf-8", "replace"))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return (n < 100) | (100 * distinct < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | (symbols > 0) << 3


class Trie:
    """A compressed trie of byte strings; a terminal is numbered and holds the least id.

    A node is [edge, children by first byte, terminal or -1].
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, -1]
        self.least: list = []
        self.size = 0

    @staticmethod
    def _shared(edge: bytes, text: bytes, at: int) -> int:
        """Length of the common beginning of ``edge`` and text[at:], by halves."""
        low, high = 1, min(len(edge), len(text) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if edge[low:mid] == text[at + low : at + mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def insert(self, text: bytes, least) -> int:
        """The text's terminal, which holds the least of the ids given with it."""
        node, at = self.root, 0
        while at < len(text):
            children, first = node[1], text[at]
            child = children.get(first)
            if child is None:
                child = children[first] = [text[at:], {}, -1]
                self.size += len(text) - at
                node, at = child, len(text)
            elif text.startswith(child[0], at):
                node, at = child, at + len(child[0])
            else:
                k = self._shared(child[0], text, at)
                node = children[first] = [child[0][:k], {child[0][k]: child}, -1]
                child[0] = child[0][k:]
                at += k
        if node[2] < 0:
            node[2] = len(self.least)
            self.least.append(least)
            self.size += 200  # of objects
        elif least < self.least[node[2]]:
            self.least[node[2]] = least
        return node[2]

    def traverse(self) -> Iterator[tuple[bytes, int]]:
        """All texts in order, with their terminals."""
        todo = [(b"", self.root)]
        while todo:
            before, node = todo.pop()
            here = before + node[0]
            if node[2] >= 0:
                yield here, node[2]
            todo += [(here, node[1][c]) for c in sorted(node[1], reverse=True)]


_ROW = [("bucket", pa.int32()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary())]


def _emit(kind: pa.DataType, ids: list, bucket: list, part: list, mask: list, n: list, text: list) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about a megabyte of text."""
    begin = held = 0
    for i in range(len(ids) + 1):
        if i == len(ids) or held > 1 << 20 or i - begin >= 10_000:
            if i > begin:
                columns = [pa.array(x[begin:i], t) for x, (_, t) in zip((bucket, part, mask, n, text), _ROW, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin:i], kind), *columns], names=["id", *[c for c, _ in _ROW]])
            begin, held = i, 0
        if i < len(ids):
            held += len(text[i] or b"")


def _local(cuts: list[bytes], spread: int):
    """Tries of a task's own texts: duplicates leave without text, one row a terminal and part with it."""
    def close(trie: Trie, kind: pa.DataType, ids: list, parts: list, slots: list, masks: list) -> Iterator[pa.RecordBatch]:
        lone: dict[tuple, int] = {}
        out: tuple[list, ...] = ([], [], [], [], [], [])

        def put(*row) -> None:
            for column, value in zip(out, row, strict=True):
                column.append(value)

        for k, (i, p, s) in enumerate(zip(ids, parts, slots, strict=True)):
            if i > trie.least[s]:
                put(i, -1 - k % spread, p, masks[s] | 16, 1, None)
            else:
                lone[s, p] = lone.get((s, p), 0) + 1
        by_slot: dict[int, list] = {}
        for (s, p), n in lone.items():
            by_slot.setdefault(s, []).append((p, n))
        for text, s in trie.traverse():
            for p, n in by_slot.get(s, ()):
                put(trie.least[s], bisect_right(cuts, text), p, masks[s], n, text)
        yield from _emit(kind, *out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ids, parts, slots, masks = Trie(), [], [], [], []
        alone: tuple[list, list] = ([], [])  # part and mask of rows without id, which no trie holds
        kind = None

        def close_alone() -> Iterator[pa.RecordBatch]:
            n = len(alone[0])
            yield from _emit(kind, [None] * n, [-1 - k % spread for k in range(n)], alone[0], alone[1], [1] * n, [None] * n)
            alone[0].clear()
            alone[1].clear()

        for batch in batches:
            kind = batch.column("id").type
            for i, p, raw in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist(), batch.column("text"), strict=True):
                text = raw.as_py()
                if i is None:
                    alone[0].append(p)
                    alone[1].append(text_mask(text))
                    if len(alone[0]) >= 10_000:
                        yield from close_alone()
                    continue
                slot = trie.insert(text, i)
                if slot == len(masks):
                    masks.append(text_mask(text))
                ids.append(i)
                parts.append(p)
                slots.append(slot)
                if trie.size > TRIE_BYTES or len(ids) > 1 << 20:
                    yield from close(trie, kind, ids, parts, slots, masks)
                    trie, ids, parts, slots, masks = Trie(), [], [], [], []
        if ids:
            yield from close(trie, kind, ids, parts, slots, masks)
        yield from close_alone()
    return run


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of a range's texts, which come in order: the flag of each row."""
    trie, slots, rows = Trie(), [], []
    last = None

    def close() -> Iterator[pa.RecordBatch]:
        begin = 0
        for batch in rows:
            ids = batch.column("id").to_pylist()
            more = np.array([16 if i > trie.least[s] else 0 for i, s in zip(ids, slots[begin : begin + len(ids)], strict=True)], np.int32)
            begin += len(ids)
            mask = batch.column("mask").to_numpy() | more
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(mask), batch.column("n")], names=["id", "part", "mask", "n"])

    for batch in batches:
        texts = batch.column("text")
        done = texts.null_count  # nulls come first
        narrow = batch.select(["id", "part", "mask", "n"])
        if done:
            yield narrow.slice(0, done)
        begin = done
        for k in range(done, batch.num_rows):
            text = texts[k].as_py()
            if trie.size > TRIE_BYTES and text != last:
                rows.append(narrow.slice(begin, k - begin))
                yield from close()
                trie, slots, rows, begin = Trie(), [], [], k
            slots.append(trie.insert(text, batch.column("id")[k].as_py()))
            last = text
        rows.append(narrow.slice(begin, batch.num_rows - begin))
    yield from close()


def _cut(low: bytes, high: bytes) -> bytes:
    """The shortest prefix of ``high`` above ``low``."""
    return high[: Trie._shared(high, low, 0) + 1 if low[:1] == high[:1] and low else 1]


def adaptive_cuts(texts: DataFrame, ranges: int) -> list[bytes]:
    """Prefixes that part the texts (column text, binary) into about ``ranges`` ranges of equal bytes."""
    size = F.octet_length("text") + F.lit(64)
    n, total = texts.agg(F.count("*"), F.sum(size)).first()
    if not n or ranges < 2:
        return []
    found: set[bytes] = set()
    want = min(SAMPLE * ranges, SAMPLE_MAX)
    share, todo = total / ranges, [(b"", texts, n, total, FIRST_PREFIX)]
    while todo:
        shared, some, count, size_of, length = todo.pop()
        wanted = max(SAMPLE, min(want, int(want * size_of / total)))
        picked = some if count <= wanted else some.sample(min(1.0, 1.2 * wanted / count), seed=7)
        rows = sorted((bytes(r[0]), r[1]) for r in picked.select(F.substring("text", 1, length), size).collect())
        weight = sum(w for _, w in rows)
        parts, seen = size_of / share, 0.0
        for (low, w), (high, _) in itertools.pairwise(rows):
            seen += w
            if low != high and int(seen * parts / weight) > int((seen - w) * parts / weight):
                found.add(_cut(low, high))
        if length >= LAST_PREFIX:
            continue
        for prefix, same in itertools.groupby(rows, key=lambda r: r[0]):
            heavy = sum(w for _, w in same) / weight * size_of
            if heavy > 2 * share and len(prefix) == length:  # many texts begin alike: look further into them
                inside = texts.where(F.substring("text", 1, length) == F.lit(prefix))
                c, s = inside.agg(F.count("*"), F.sum(size)).first()
                todo.append((prefix, inside, c, s, 8 * length))
    return sorted(found)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n): rows by id, part and the bits of the failed filters."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text")
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part")
    kind = docs.schema[id_col].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = adaptive_cuts(docs.select(text), RANGES * partitions)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), part, text)
    local = rows.mapInArrow(_local(cuts, 4 * partitions), f"id {kind}, bucket int, part string, mask int, n long, text binary")
    placed = local.repartition(partitions, "bucket").sortWithinPartitions("text")
    return placed.select("id", "part", "mask", "n", "text").mapInArrow(_ranged, f"id {kind}, part string, mask int, n long")


def _steps() -> str:
    """All orders and steps as SQL: the filter's bit and those before it."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            out.append(f"struct('{''.join(order)}' AS filter_order, {k + 1} AS step, {before} AS before, {bit} AS bit)")
            before |= bit
    return f"array({', '.join(out)})"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What every filter removes in every order, by part."""
    named = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = judged(docs, id_col, text_col, part_col)
    both = rows.join(named, rows["id"] == named["key"], "left")
    n, whole = F.col("n"), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    # 32 cells a part, written since two aggregates read them; each has the 600 steps
    cells = settle(both.groupBy("part", "mask").agg(F.sum("n").alias("n"), whole(F.when(F.col("good") == 1, n)).alias("good"), whole(F.when(F.col("toxic") == 1, n)).alias("toxic")))
    at = cells.select("*", F.expr(f"inline({_steps()})"))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    lost = fails & ~earlier
    steps = at.groupBy("part", "filter_order", "step", "bit").agg(
        whole(F.when(~fails & ~earlier, n)).alias("kept"), whole(F.when(lost, n)).alias("removed"), whole(F.when(fails & earlier, n)).alias("redundant"),
        whole(F.when(F.col("mask") == F.col("bit"), n)).alias("unique_fails"), whole(F.when(lost, F.col("good"))).alias("good_lost"), whole(F.when(lost, F.col("toxic"))).alias("toxic_lost"))
    # all steps of a part and filter: 120 rows
    share = steps.groupBy(F.col("part").alias("p"), F.col("bit").alias("f")).agg(F.sum("removed").alias("shapley"))
    out = steps.join(share, (steps["part"] == share["p"]) & (steps["bit"] == share["f"]))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
