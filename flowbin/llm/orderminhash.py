"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Shingles are ``K`` consecutive words, each labelled with its occurrence number in the text.
A sketch is made of ``BANDS * ROWS`` samples; a sample is the ``TUPLE`` labelled shingles of
least hash, *in the order in which they stand in the text*, so that it agrees for texts
that agree in content and order.  ``ROWS`` samples make a band; documents that share a band
are candidates.  Two texts in which every ninth word differs (similarity 0.8) share about
0.38 of their shingles, so that a sample agrees with a chance of 0.15 and one of ``BANDS`` with 0.98.

Candidates are aligned word by word: the similarity of two texts with m and n words is
c / (m + n - c), where c is the length of the longest common subsequence of their words
within a band of diagonals that no alignment of the wanted similarity can leave.  From
``THRESHOLD`` on, the texts are linked, and the classes are the connected components.
Pairs whose sizes or whose words, whatever their order, cannot reach it are not aligned.

Texts of the same words are one node, named by a hash; a second, independent hash tells
texts apart that share a name.  In each band bucket every member is first aligned with the
most central one, whose buckets hold most other members.  Where a bucket then has members of
several classes, they are aligned with two leaders drawn by hash, unless they are of a leader's
class.  All leaders are ranked by node alone, so that the buckets of one group agree on few of them.
A bucket is settled if its members are of one class by then, or if every pair in it has a leader.
In every other bucket (of a template, say) all pairs of different classes are compared by marks, in
cells of two blocks of at most about ``BLOCK`` members each; members of the bucket's largest class meet
the others only, never each other.  A mark is ``MARKS`` times 64 bits or, for longer texts, a doubled
number, about four to eight for each word: the parities of the text's labelled words by hash.  Two
marks differ in no more bits than the texts have words that are not common, of which near texts
have at most (1 - t) / (1 + t) of all.  The pairs left, each found in one bucket only, are aligned.
So two near texts that share a bucket are always in one class; nothing is capped or drawn.

Defined results: a null text, an empty one or one without words is in no class but its own;
a text of fewer than K words is one shingle; repeated rows and equal texts share a class,
whatever their ids; a null id has a null class unless an equal or near text has an id.
The class id is the least document id of the class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbin.llm import textscan as scan
from flowbin.llm.components import components
from flowbin.llm.frames import Packed, pack, settle

K = 5
THRESHOLD = 0.8
TUPLE = 2
ROWS = 1
BANDS = 24
BROADCAST_ROWS = 1_000_000
BLOCK = 512
MARKS = 4
WIDEST = 8  # doublings of MARKS, which bound the memory of a cell


def shingles(w: scan.Words, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle; a row of fewer than K words has one."""
    h = w.hashes(seed)
    at, key = scan.windows(w, h, K, seed)
    few = np.flatnonzero((w.counts > 0) & (w.counts < K))
    if len(few):
        short = scan.span_hash(h, w.first[:-1][few], w.first[1:][few], seed)
        row = np.concatenate([w.row[at], few])
        key = np.concatenate([key, short])
        order = np.argsort(row, kind="stable")
        return row[order], key[order]
    return w.row[at], key


def labelled(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Shingle hashes with the number of the occurrence in the row mixed in."""
    order = np.lexsort((key, row))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    out = np.empty(len(key), np.uint64)
    out[order] = scan.mix(key[order] ^ scan.mix(nth.astype(np.uint64), 41), 42)
    return out


def bands(row: np.ndarray, label: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their band keys (rows x BANDS)."""
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    if len(start) == 0:
        return start, np.zeros((0, BANDS), np.uint64)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(row))))
    odd = scan.mix(np.arange(BANDS * ROWS, dtype=np.uint64), 47) | np.uint64(1)
    keys = np.zeros((len(start), BANDS), np.uint64)
    top = np.uint64((1 << 64) - 1)
    padded = np.append(label, np.uint64(0))
    for s in range(BANDS * ROWS):
        value = label * odd[s]  # a bijection, so that a row's values differ
        chosen = []
        for _ in range(TUPLE):
            least = np.minimum.reduceat(value, start)
            hit = np.flatnonzero(value == least[group])
            at = hit[np.searchsorted(hit, start)]
            chosen.append(np.where(least == top, len(row), at))  # fewer shingles than TUPLE
            value[at] = top
        for at in np.sort(np.stack(chosen), axis=0):  # in text order
            keys[:, s // ROWS] = scan.mix(keys[:, s // ROWS] * np.uint64(0x9E3779B97F4A7C15) + padded[at], 43)
    return row[start], keys


def node_hashes(w: scan.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the words of each row: its name, and the proof of the name."""
    one, two = (scan.span_hash(w.hashes(s), w.first[:-1], w.first[1:], s) for s in (0, 1))
    return scan.mix(one, 45).view(np.int64), scan.mix(two, 46).view(np.int64)


def _sketch(schema: pa.Schema):
    """id, node, proof, words and band keys of every row; node, proof and keys null without words."""
    def run(batches):
        for b in scan.slices(batches, "text"):
            w = scan.words(*scan.buffers(b.column("text")))
            row, key = shingles(w)
            of, keys = bands(row, labelled(row, key), w.rows)
            band = np.arange(BANDS, dtype=np.uint64)
            flat = scan.mix(keys + band, 44).view(np.int64).ravel()
            size = np.zeros(w.rows + 1, np.int64)
            size[of + 1] = BANDS
            names = [pa.array(x, mask=w.counts == 0) for x in node_hashes(w)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("id"), *names, pa.array(w.counts, pa.int64()), lists], schema=schema)

    return run


def _own_text(schema: pa.Schema):
    """(node, text) of the rows whose words have the wanted proof."""
    def run(batches):
        for b in scan.slices(batches, "text"):
            w = scan.words(*scan.buffers(b.column("text")))
            same = pa.array(node_hashes(w)[1] == b.column("proof").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("node").filter(same), b.column("text").filter(same)], schema=schema)

    return run


def _with_proof(schema: pa.Schema):
    def run(batches):
        for b in scan.slices(batches, "text"):
            w = scan.words(*scan.buffers(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node_hashes(w)[1], mask=w.counts == 0)], schema=schema)

    return run


def common(a: list[int], b: list[int], threshold: float = THRESHOLD) -> int:
    """Length of the longest common subsequence by matches close enough to the diagonal.

    Exact for every pair that reaches the threshold; a bit-parallel row sweep in which the
    window of bits moves along with the diagonal.
    """
    m, n = len(a), len(b)
    need = math.ceil(threshold * (m + n) / (1 + threshold) - 1e-6)
    spare = m + n - 2 * need  # most insertions and deletions together
    if spare < abs(m - n):
        return 0
    reach = (spare + abs(m - n)) // 2 + 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    width = 2 * reach + 1
    full = (1 << width) - 1
    window, low, total = full, -reach, 0  # bit i of the window is position low + i; 1: not used up
    for y in b:
        match = where.get(y, 0)
        if match:
            match = (match >> low if low >= 0 else match << -low) & full
            if match:
                window = ((window + (window & match)) | (window & ~match)) & full
        total += not window & 1
        window = (window >> 1) | (1 << (width - 1))
        low += 1
    return total + width - window.bit_count()


def similarity(a: list[int], b: list[int], threshold: float = THRESHOLD) -> float:
    """Alignment similarity of two word sequences (0 if it cannot reach the threshold)."""
    c = common(a, b, threshold)
    return c / (len(a) + len(b) - c) if c else 0.0


def _labels(w: scan.Words) -> np.ndarray:
    """Hashes of the words with their occurrence number in the row."""
    return labelled(w.row, w.hashes())


def _in_common(a: scan.Words, b: scan.Words) -> np.ndarray:
    """How many words the texts of each row have in common in any order, a bound of every alignment."""
    x, y = (_labels(w) ^ scan.mix(w.row.astype(np.uint64), 49) for w in (a, b))
    return np.bincount(a.row[np.isin(x, y)], minlength=a.rows)


def _verify(threshold: float, schema: pa.Schema):
    def run(batches):
        for b in scan.slices(batches, "a_text"):
            x, y = (scan.words(*scan.buffers(b.column(name))) for name in ("a_text", "b_text"))
            good = _in_common(x, y) >= threshold / (1 + threshold) * (x.counts + y.counts) - 1e-6
            hx, hy = x.hashes(), y.hashes()
            for i in np.flatnonzero(good).tolist():
                a, c = hx[x.first[i] : x.first[i + 1]].tolist(), hy[y.first[i] : y.first[i + 1]].tolist()
                good[i] = similarity(a, c, threshold) >= threshold
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good)), b.column("b").filter(pa.array(good))], schema=schema)

    return run


def marks(row: np.ndarray, label: np.ndarray, rows: int, wide: int = MARKS) -> np.ndarray:
    """The parities of each row's labels in ``wide`` times 64 hashed bits (rows x wide)."""
    bit = scan.mix(label, 50) % np.uint64(64 * wide)
    at = row * wide + (bit >> np.uint64(6)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, one = at[order], np.uint64(1) << (bit[order] & np.uint64(63))
    out = np.zeros(rows * wide, np.uint64)
    if len(at):
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[start]] = np.bitwise_xor.reduceat(one, start)
    return out.view(np.int64).reshape(rows, wide)


def _marked(threshold: float, schema: pa.Schema):
    """The mark of each text in the tier of its size (``own``), and in each higher one in which near texts can be."""
    def run(batches):
        for b in scan.slices(batches, "text"):
            w = scan.words(*scan.buffers(b.column("text")))
            row, label, size = w.row, _labels(w), w.counts
            own = np.frexp((size - 1) // (16 * MARKS))[1]  # tier k ends at 16 * MARKS << k words
            tier = int(own.min())
            while True:
                least = (16 * MARKS << tier - 1) + 1 if tier else 0  # words of the tier's shortest texts
                here = (own == tier) | (own < tier) & (size >= threshold * least - 1e-6)
                if here.any():
                    at = np.flatnonzero(here)
                    of = here[row]
                    mark = marks((np.cumsum(here) - 1)[row[of]], label[of], len(at), MARKS << min(tier, WIDEST))
                    taken = [b.column(c).take(pa.array(at)) for c in ("node", "label", "buckets")]
                    columns = [pa.array(size[at]), pa.array(np.full(len(at), tier, np.int32)), pa.array(own[at] == tier), pa.array([m.tobytes() for m in mark], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*taken, *columns], schema=schema)
                elif tier > own.max():
                    break
                tier += 1

    return run


def _cell(threshold: float):
    """(a, b) of the pairs between the blocks ``low`` and ``high`` of a bucket that can be near.

    A pair is told in the least bucket that it shares and in the tier of its longer text.
    """
    def run(key, cell):
        bucket, _, low, high = (k.as_py() for k in key)
        node, label, size, own, at = (cell[c].to_numpy() for c in ("node", "label", "size", "own", "at"))
        mark = np.frombuffer(b"".join(cell["mark"].to_pylist()), np.uint64).reshape(len(node), -1)
        lists = cell["buckets"].combine_chunks()
        count = lists.value_lengths().to_numpy()
        held = np.full((len(node), count.max()), bucket)
        held[np.arange(held.shape[1]) < count[:, None]] = lists.flatten().to_numpy()
        others = np.flatnonzero(at == high)
        a, b = [], []
        for i in np.flatnonzero(at == low).tolist():
            y = others[others > i] if low == high else others
            y = y[(label[y] != label[i]) & (own[y] | own[i]) & (np.minimum(size[y], size[i]) >= threshold * np.maximum(size[y], size[i]) - 1e-6)]
            both = size[y] + size[i]
            y = y[np.bitwise_count(mark[y] ^ mark[i]).sum(axis=1, dtype=np.int64) <= (1 - threshold) / (1 + threshold) * both + 1e-6]
            if len(y):
                y = y[np.where(np.isin(held[y], held[i]), held[y], bucket).min(axis=1) == bucket]
                a.append(np.minimum(node[y], node[i]))
                b.append(np.maximum(node[y], node[i]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    return run


def _unsettled(member: DataFrame, lead: DataFrame, label: DataFrame) -> DataFrame:
    """``member`` and label of those in buckets with pairs of two classes and without a leader."""
    named = member.join(label, "node", "left").select("bucket", "node", "size", "n", F.coalesce("label", "node").alias("label"))
    of = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.first("n").alias("n")).where("x < y")
    left = settle(of.join(lead, "bucket").where("n > size(leads) + 1").select("bucket"))
    return settle(named.join(left, "bucket").select(named.columns))


def _rest(open_: DataFrame, text: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of all pairs of different labels in one of the buckets that can be near, each once."""
    nodes = open_.groupBy("node").agg(F.first("label").alias("label"), F.collect_set("bucket").alias("buckets"))
    names = T.StructType([T.StructField("node", T.LongType()), T.StructField("label", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType())),
                          T.StructField("size", T.LongType()), T.StructField("tier", T.IntegerType()), T.StructField("own", T.BooleanType()), T.StructField("mark", T.BinaryType())])
    whole = text.join(nodes, "node").select("node", "label", "buckets", "text")
    marked = settle(whole.mapInArrow(_marked(threshold, to_arrow_schema(names)), names))
    # the largest class of a bucket and tier, and the blocks of the others and of that class
    of = marked.select(F.explode("buckets").alias("bucket"), "tier", "label").groupBy("bucket", "tier", "label").agg(F.count("*").alias("n"))
    of = of.groupBy("bucket", "tier").agg(F.max_by("label", "n").alias("most"), F.max("n").alias("many"), F.sum("n").alias("n")).where("n > many")
    of = _checked(settle(of.select("bucket", "tier", "most", F.ceil((F.col("n") - F.col("many")) / BLOCK).alias("few"), F.ceil(F.col("many") / BLOCK).alias("blocks"))))
    placed = marked.withColumn("bucket", F.explode("buckets")).join(of, ["bucket", "tier"])
    placed = placed.withColumn("at", F.expr("IF(label = most, few + pmod(node, blocks), pmod(node, few))"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0L, IF(label = most, few, few + blocks) - 1L)")))
    cells = placed.select("bucket", "tier", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), "at", "node", "label", "buckets", "size", "own", "mark")
    return cells.groupBy("bucket", "tier", "low", "high").applyInArrow(_cell(threshold), "a long, b long")


def _checked(frame: DataFrame) -> DataFrame:
    """Broadcast a table of a few narrow columns if its counted size allows it."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _led(member: DataFrame, lead: DataFrame, threshold: float, where: str = "true") -> DataFrame:
    """(a, b) of the members and leaders of each bucket whose sizes let them be near."""
    pairs = member.join(lead, "bucket").withColumn("lead", F.explode("leads")).where(where)
    pairs = pairs.where("node != lead.node").where(F.least("size", "lead.size") >= threshold * F.greatest("size", "lead.size") - 1e-6)
    return pairs.select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")).distinct()


def _near(pairs: DataFrame, text: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose texts are near."""
    sides = pairs.join(text.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    sides = sides.join(text.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b").select("a", "b", "a_text", "b_text")
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return sides.mapInArrow(_verify(threshold, pair), "a long, b long")


def _told_apart(sketched: DataFrame) -> DataFrame:
    """``sketched`` with a node of its own for each text whose name another text has too."""
    named = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("proof").alias("least"), F.max("proof").alias("most"))
    twice = settle(named.where("least < most").select("node", "least"))
    if twice.isEmpty():  # for 10^11 texts a few hundred are expected, for most tables none
        return sketched
    own = F.when(F.col("proof") > F.col("least"), F.xxhash64("node", "proof")).otherwise(F.col("node"))
    return settle(sketched.join(twice, "node", "left").withColumn("node", own).drop("least"))


def _grouped(packed: Packed, threshold: float) -> DataFrame:
    """(id, node, proof, class_id) of every row."""
    rows = packed.rows.select("id", "text")
    names = ("id", "node", "proof", "size")
    out = T.StructType([*[T.StructField(c, T.LongType()) for c in names], T.StructField("keys", T.ArrayType(T.LongType()))])
    sketched = _told_apart(settle(rows.mapInArrow(_sketch(to_arrow_schema(out)), out)))
    texts = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.min("proof").alias("proof"))

    member = sketched.where("node IS NOT NULL").select(F.explode("keys").alias("bucket"), "node", "size").distinct()
    several = settle(member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    member = settle(member.join(several, "bucket"))
    central = member.groupBy("node").agg(F.sum("n").alias("near"))
    # the leaders of a bucket are minima and maxima, aggregated before the shuffle
    most = F.max(F.struct("near", "node", "size"))
    lead = member.join(central, "node").groupBy("bucket").agg(most.alias("most"))
    lead = settle(lead.select("bucket", F.array(F.struct("most.node", "most.size")).alias("leads")))
    pairs = settle(_led(member, lead, threshold))

    # texts of the candidates alone, each from a row of its least id
    needed = _checked(settle(member.select("node").distinct().join(texts, "node").select("node", "proof", F.col("id").alias("of"))))
    own = T.StructType([T.StructField("node", T.LongType()), T.StructField("text", T.StringType())])
    text = rows.join(needed, rows["id"].eqNullSafe(needed["of"])).select("node", "proof", "text").mapInArrow(_own_text(to_arrow_schema(own)), own)
    text = settle(text.dropDuplicates(["node"]))
    links = settle(_near(pairs, text, threshold))
    label = components(links)
    open_ = _unsettled(member, lead, label)
    if not open_.isEmpty():
        one = F.struct("node", "size", "label")
        drawn = [F.min(F.struct(F.xxhash64("node", F.lit(k)), one.alias("one")))["one"] for k in (1, 2)]
        more = settle(open_.groupBy("bucket").agg(F.array_distinct(F.array(*drawn)).alias("more")))
        apart = _led(open_, more.withColumnRenamed("more", "leads"), threshold, "label != lead.label")
        found = settle(_near(apart, text, threshold))
        if not found.isEmpty():
            links = links.unionByName(found)
            label = components(links)
        lead = lead.join(more, "bucket").select("bucket", F.array_union("leads.node", "more.node").alias("leads"))
        open_ = _unsettled(open_.drop("label"), lead, label)
    if not open_.isEmpty():
        found = settle(_near(settle(_rest(open_, text, threshold)), text, threshold))
        if not found.isEmpty():
            label = components(links.unionByName(found))

    grouped = texts.join(label, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    # a written table, so that the join splits a label with a large share of the nodes
    least = settle(grouped.groupBy("label").agg(F.min("id").alias("class_id")))
    found = grouped.join(least, "label").select("node", "class_id")
    whole = sketched.select("id", "node", "proof").join(found, "node", "left")
    return settle(whole.select("id", "node", "proof", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, node), one row for each document.

    node names the words, null for a text without any.
    """
    found = _grouped(pack(docs, id_col, text_col, "near"), threshold)
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "class_id", "node")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: that with the least id.  Rows without words stay, all of them.

    Where several rows have that id, the least text stays; of rows that differ in other
    columns only, any one.  A class without any id keeps its rows.
    """
    packed = pack(docs, id_col, text_col, "near")
    found = _grouped(packed, threshold)
    out = T.StructType([*packed.rows.schema.fields, T.StructField("proof", T.LongType())])
    rows = packed.rows.mapInArrow(_with_proof(to_arrow_schema(out)), out)
    wanted = found.where("node IS NULL OR class_id IS NULL OR id = class_id").select(F.col("id").alias("i"), F.col("proof").alias("p"), "class_id").distinct()
    kept = rows.join(_checked(wanted), rows["id"].eqNullSafe(F.col("i")) & rows["proof"].eqNullSafe(F.col("p"))).select("id", "text", "rest", "proof", "class_id")
    # several rows of one class with its id: only where ids or rows repeat
    ids = packed.rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 AND id IS NOT NULL")
    twins = settle(ids.select(F.col("id").alias("class_id")))
    if not twins.isEmpty():
        first = F.col("proof").isNotNull() & F.col("class_id").isNotNull()
        several = kept.where(first).join(twins, "class_id")
        one = several.groupBy("class_id").agg(F.min_by(F.struct("id", "text", "rest", "proof"), "text").alias("row")).select("row.*", "class_id")
        kept = kept.where(~first).unionByName(kept.where(first).join(twins, "class_id", "left_anti").select(kept.columns)).unionByName(one.select(kept.columns))
    return packed.unpack(kept, F.lit(0)).drop("near")
