"""Near-duplicate vectors by sorted projection passes.

Vectors are compared by cosine, only within equal labels and lengths.

1. Every pass turns a vector into a string of random hashes: under a random rotation, the
   axis nearest to the vector and its side.  Near vectors agree in their first hashes.  The
   vectors are ordered by label and string over range partitions of all passes at once, and
   each is compared with its WINDOW successors.  Vectors that end a partition meet those that
   begin the next one in a second, small step.
2. The windows hold bytes instead of doubles, with the length of the rounding error, which
   bounds the cosine on both sides: most pairs are settled by the bytes, the others by a join
   with the full vectors.  Settled pairs leave a window as a spanning forest.
3. The pairs of all passes are united into components.
4. Within a component every link is counted, also those that no window held.  Components of
   at most SMALL vectors are compared in place.  In a larger one, vectors within half the
   threshold's angle of the centre are all linked (triangle inequality) and are counted, not
   compared; the others meet blocks of the component whose angle to the centre allows a link.

Number of passes: :func:`passes_for`, from the size of the largest label, so that a lone pair
exactly at the threshold is found with a chance of at least 1 - MISS at every size.  Members
of larger groups have more ways to be found.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component,
and one whose label is null, links with nothing.  Repeated rows (also of one id) are vectors
of their own.  A null id is never the least of its component unless all ids there are null;
a vector without id is kept unless its component has an id.  Vectors of other lengths never
link.  Very long vectors work, a rotation of their length is made for each hash.  An empty table
gives an empty result.  An input column with the result's name is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbin.llm.components import components
from flowbin.llm.frames import settle

THRESHOLD = 0.93
WINDOW = 256   # successors that a vector is compared with in a pass
MISS = 0.03    # chance that no pass shows a lone pair at the threshold
SMALL = 256    # members of a component that are compared in place
BLOCK = 512    # vectors of one matrix product
CODE_BITS = 42


@lru_cache(maxsize=512)
def _rotation(dim: int, turn: int, k: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([11, dim, turn, k]).normal(size=(dim, dim)))[0]


def _hashes(units: np.ndarray, turn: int) -> np.ndarray:
    """The string of hashes of one pass, as an integer with the first hash in front."""
    dim = units.shape[1]
    code = np.zeros(len(units), np.int64)
    for k in range(max(1, CODE_BITS // int(math.log2(2 * dim)))):
        turned = units @ _rotation(dim, turn, k)
        axis = np.abs(turned).argmax(axis=1)
        side = turned[np.arange(len(units)), axis] > 0
        code = code * (2 * dim) + 2 * axis + side
    return code


@lru_cache(maxsize=64)
def hash_agreement(dim: int, threshold: float, draws: int = 4000) -> float:
    """How often two vectors at the threshold have one hash in common, by simulation."""
    rng = np.random.default_rng([12, dim])
    a = rng.normal(size=(draws, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim == 1:
        return 1.0
    z = rng.normal(size=(draws, dim))
    z -= (z * a).sum(axis=1, keepdims=True) * a
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * z / np.linalg.norm(z, axis=1, keepdims=True)
    side = lambda x: (lambda t, i: 2 * i + (t[np.arange(draws), i] > 0))(x, np.abs(x).argmax(axis=1))
    return float((side(a) == side(b)).mean())


def passes_for(n: int, dim: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes for ``n`` vectors of a label: so many hashes in common bring two of them into one window."""
    depth = max(1.0, math.log(max(n, 2) / window) / math.log(2 * dim)) if n > window else 0.0
    found = min(hash_agreement(dim, threshold) ** depth, 1 - 1e-9)
    return max(1, math.ceil(math.log(miss) / math.log(1 - found)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def _units(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), batch if len(at) == len(dims) else batch.take(pa.array(at))


_CODED = "turn int, label string, dim int, code long, node long, bytes binary"


def _coder(passes: dict[int, int]):
    """One row for each vector and pass: its hashes and its rounded direction."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in _by_dim(whole):
                for begin in range(0, batch.num_rows, 4096):
                    part = batch.slice(begin, 4096)
                    units = _units(_matrix(part.column("vec"), dim))
                    step = np.abs(units).max(axis=1).astype(np.float32).astype(np.float64) / 127
                    whole_steps = np.clip(np.rint(units / step[:, None]), -127, 127).astype(np.int8)
                    lost = np.linalg.norm(units - whole_steps * step[:, None], axis=1) * (1 + 1e-6) + 1e-7
                    tail = np.stack([step, lost], axis=1).astype(np.float32).view(np.int8).reshape(len(units), 8)
                    packed = np.concatenate([whole_steps, tail], axis=1)
                    offsets = pa.py_buffer(np.arange(len(units) + 1, dtype=np.int32) * (dim + 8))
                    small = pa.Array.from_buffers(pa.binary(), len(units), [None, offsets, pa.py_buffer(packed.tobytes())])
                    for turn in range(passes[dim]):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(units), turn, np.int32)), part.column("label"), part.column("dim"),
                            pa.array(_hashes(units, turn)), part.column("node"), small], names=["turn", "label", "dim", "code", "node", "bytes"])
    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least position linked with each of n positions, directly or through others."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _runs(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """A number for each stretch of equal keys."""
    change = np.zeros(batch.num_rows, bool)
    for name in names:
        column = batch.column(name)
        codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(column.type) else column.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def _directions(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rounded directions (shorter ones padded with zeros) and the lengths of their errors."""
    dims = batch.column("dim").to_numpy()
    out = np.zeros((batch.num_rows, int(dims.max())), np.float32)
    lost = np.zeros(batch.num_rows, np.float32)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        small = batch.column("bytes").take(pa.array(at))
        raw = np.frombuffer(b"".join(small.to_pylist()), np.int8).reshape(len(at), dim + 8)
        tail = np.ascontiguousarray(raw[:, dim:]).view(np.float32)
        out[at, :dim] = raw[:, :dim] * tail[:, :1]
        lost[at] = tail[:, 1]
    return out, lost


_FOUND = "kind int, a long, b long, edge int, turn int, label string, dim int, code long, node long, bytes binary"
_SURE, _OPEN, _EDGE = 0, 1, 2
_KEYS = ["turn", "label", "dim"]


def _pairs(batch: pa.RecordBatch, keys: list[str], window: int, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Links among ordered rows, each against its successors: forests of sure ones, and open pairs."""
    run, nodes = _runs(batch, keys), batch.column("node").to_numpy()
    vectors, lost = _directions(batch)
    n = len(nodes)
    for begin in range(0, n, BLOCK):
        i, j = slice(begin, min(n, begin + BLOCK)), slice(begin, min(n, begin + BLOCK + window))
        gap = np.arange(j.start, j.stop)[None, :] - np.arange(i.start, i.stop)[:, None]
        near = (gap > 0) & (gap <= window) & (run[i][:, None] == run[j][None, :])
        dots = vectors[i] @ vectors[j].T
        err = lost[i][:, None] + lost[j][None, :]
        err += err * err + np.float32(1e-5)
        sure = near & (dots - err >= threshold)
        unsure = near & ~sure & (dots + err >= threshold)
        a, b = np.nonzero(sure)
        if len(a):
            root = _forest(a, b, j.stop - j.start)
            at = np.flatnonzero(root != np.arange(len(root)))
            yield _SURE, nodes[j][at], nodes[j][root[at]]
        a, b = np.nonzero(unsure)
        if len(a):
            yield _OPEN, nodes[i][a], nodes[j][b]


def _found(kind: int, a: np.ndarray, b: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    n = len(a)
    made = {"kind": pa.array(np.full(n, kind, np.int32)), "a": pa.array(a), "b": pa.array(b)}
    return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int32()), ("turn", pa.int32()), ("label", pa.string()),
                          ("dim", pa.int32()), ("code", pa.int64()), ("node", pa.int64()), ("bytes", pa.binary())])


def _join(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _windows(window: int, threshold: float, edges: bool):
    """Compare each row with its successors in a partition; ``edges``: hand out its first and last rows too."""
    keys = _KEYS if edges else ["edge", *_KEYS]

    def edge(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        n = batch.num_rows
        made = {"kind": pa.array(np.full(n, _EDGE, np.int32)), "edge": pa.array(np.full(n, number, np.int32))}
        made |= {c: batch.column(c) for c in (*_KEYS, "code", "node", "bytes")}
        return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(n, f.type)) for f in _FOUND_ARROW], schema=_FOUND_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        given = 0  # of the partition's first rows
        for batch in batches:
            for begin in range(0, batch.num_rows, 4 * BLOCK):
                part = batch.slice(begin, 4 * BLOCK)
                if edges and given < window:
                    head = part.slice(0, window - given)
                    given += head.num_rows
                    yield edge(head, place - 1)
                whole = part if held is None else _join([held, part])
                for kind, a, b in _pairs(whole, keys, window, threshold):
                    yield _found(kind, a, b, _FOUND_ARROW)
                held = whole.slice(max(0, whole.num_rows - window))
        if edges and held is not None:
            yield edge(held, place)
    return run


def _near(threshold: float):
    """The pairs whose vectors are near, in doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in _by_dim(whole):
                for begin in range(0, batch.num_rows, 4096):
                    part = batch.slice(begin, 4096)
                    a, b = (_units(_matrix(part.column(c), dim)) for c in ("vec_a", "vec_b"))
                    at = pa.array(np.flatnonzero((a * b).sum(axis=1) >= threshold))
                    yield part.select(["a", "b"]).take(at)
    return run


def _sum_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the directions of each component in a batch, by coordinate."""
    for whole in batches:
        for dim, batch in _by_dim(whole):
            comp, at = np.unique(batch.column("comp").to_numpy(), return_inverse=True)
            total = np.zeros((len(comp), dim))
            for begin in range(0, batch.num_rows, 4096):
                np.add.at(total, at[begin : begin + 4096], _units(_matrix(batch.column("vec").slice(begin, 4096), dim)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(comp, dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(comp))), pa.array(total.ravel())],
                                             names=["comp", "k", "x"])


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The angle of each vector to the centre of its component; to a centre of zero, a right angle."""
    for whole in batches:
        for dim, batch in _by_dim(whole):
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                centre = _matrix(part.column("centre"), dim)
                size = np.linalg.norm(centre, axis=1)
                cosine = (_units(_matrix(part.column("vec"), dim)) * centre).sum(axis=1) / np.maximum(size, 1e-300)
                angle = np.where(size > 1e-9, np.arccos(np.clip(cosine, -1, 1)), math.pi / 2)
                yield pa.RecordBatch.from_arrays([*part.select(["comp", "node", "dim", "vec"]).columns, pa.array(angle)], names=["comp", "node", "dim", "vec", "angle"])


def linkable(vec: Column) -> Column:
    """Not null, not empty, all components finite, one not zero."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda v: v != 0), F.lit(False))


def candidate_links(rows: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(a, b): verified links of all passes, a spanning forest of those in each window."""
    sizes = rows.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n"))
    passes = {r["dim"]: passes_for(r["n"], r["dim"], threshold, window) for r in sizes.collect()}  # one row for each length of vectors
    schema = "kind int, a long, b long"
    if not passes:
        return rows.sparkSession.createDataFrame([], schema).select("a", "b")
    order = ["turn", "label", "dim", "code", "node"]
    coded = rows.select("node", "label", "dim", "vec").mapInArrow(_coder(passes), _CODED)
    ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    found = settle(ordered.mapInArrow(_windows(window, threshold, True), _FOUND))
    seams = found.where(F.col("kind") == _EDGE).select("edge", *order, "bytes").repartition("edge").sortWithinPartitions("edge", *order)
    seamed = settle(seams.mapInArrow(_windows(window, threshold, False), _FOUND).select("kind", "a", "b"))
    both = found.select("kind", "a", "b").unionByName(seamed)
    sure = both.where(F.col("kind") == _SURE).select("a", "b")
    pair = both.where(F.col("kind") == _OPEN).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: rows.select(F.col("node").alias(c), F.col("vec").alias(f"vec_{c}"))
    open_pairs = pair.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size("vec_a").alias("dim"), "vec_a", "vec_b")
    return sure.unionByName(open_pairs.mapInArrow(_near(threshold), "a long, b long"))


def _count_small(threshold: float):
    """Links of each vector of a component that is whole in the partition (rows ordered by component)."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        comp = batch.column("comp").to_numpy()
        links = np.zeros(len(comp), np.int64)
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):  # a component has one length
            at = np.flatnonzero(dims == dim)
            units, own = _units(_matrix(batch.column("vec").take(pa.array(at)), int(dim))), comp[at]
            for begin in range(0, len(at), BLOCK):
                i, j = slice(begin, begin + BLOCK), slice(max(0, begin - SMALL), begin + BLOCK + SMALL)
                near = (units[i] @ units[j].T >= threshold) & (own[i][:, None] == own[j][None, :])
                links[at[i]] = near.sum(axis=1) - 1
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(links)], names=["node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > 4 * BLOCK + SMALL:
                whole = _join(held)
                comp = whole.column("comp").to_numpy()
                cut = int(np.searchsorted(comp, comp[-1]))  # the last component may go on
                if cut:
                    yield count(whole.slice(0, cut))
                held, rows = [whole.slice(cut)], whole.num_rows - cut
        if rows:
            yield count(_join(held))
    return run


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive vectors of a component in one row: the range of their angles, and the vectors."""
    held: list[pa.RecordBatch] = []

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        comp, angle = batch.column("comp").to_numpy(), batch.column("angle").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(comp[1:] != comp[:-1]) + 1, [len(comp)]])
        cuts = [(s, min(s + SMALL, e)) for b, e in zip(starts[:-1], starts[1:], strict=True) for s in range(b, e, SMALL)]
        for s, e in cuts:
            part = batch.slice(s, e - s)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, e - s], pa.int32()), x.cast(kind))
            dim = int(part.column("dim")[0].as_py())
            flat = _matrix(part.column("vec"), dim).tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([int(comp[s])]), pa.array([dim], pa.int32()), pa.array([float(angle[s:e].min())]), pa.array([float(angle[s:e].max())]),
                one(part.column("node"), pa.int64()), one(part.column("core"), pa.bool_()), pa.array([flat], pa.binary())],
                names=["comp", "dim", "low", "high", "nodes", "cores", "flat"])

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 8 * SMALL:
            yield from blocks(_join(held))
            held, rows = [], 0
    if rows:
        yield from blocks(_join(held))


_BLOCK_TYPE = "comp long, dim int, low double, high double, nodes array<long>, cores array<boolean>, flat binary"


def _count_blocks(threshold: float):
    """Links between the outer vectors of one block and all vectors of another, counted for both sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (_units(np.frombuffer(r[c], np.float64).reshape(-1, r["dim"])) for c in ("flat", "other_flat"))
                left, right = np.array(r["nodes"]), np.array(r["other_nodes"])
                outer, inner = ~np.array(r["cores"]), np.array(r["other_cores"])
                near = (a @ b.T >= threshold) & outer[:, None] & (left[:, None] != right[None, :])
                out, back = near.sum(axis=1), np.where(inner, near.sum(axis=0), 0)
                node, n = np.concatenate([left[out > 0], right[back > 0]]), np.concatenate([out[out > 0], back[back > 0]])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])
    return run


def _count_large(members: DataFrame, threshold: float) -> DataFrame:
    """(node, n) for components of more than SMALL vectors."""
    span = math.acos(threshold)
    parts = members.select("comp", "dim", "vec").mapInArrow(_sum_units, "comp long, k int, x double")
    centre = parts.groupBy("comp", "k").agg(F.sum("x").alias("x")).groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centre"))
    # a table of its own, so that the join can split a component with many vectors
    around = members.join(settle(centre), "comp").select("comp", "node", "dim", "vec", "centre")
    vec = members.schema["vec"].dataType.simpleString()
    angled = around.mapInArrow(_angles, f"comp long, node long, dim int, vec {vec}, angle double")
    placed = settle(angled.withColumn("core", F.col("angle") <= span / 2 - 1e-7))
    inside = settle(placed.groupBy("comp").agg(F.sum(F.col("core").cast("long")).alias("cores"), F.count("*").alias("n")))
    base = placed.where("core").select("comp", "node").join(inside, "comp").select("node", (F.col("cores") - 1).alias("n"))
    loose = inside.where("cores < n").select("comp")
    order = ["comp", "angle", "node"]
    open_rows = placed.join(loose, "comp", "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = settle(open_rows.select("comp", "dim", "angle", "node", "core", "vec").mapInArrow(_pack_blocks, _BLOCK_TYPE))
    outer = blocks.where(F.exists("cores", lambda c: ~c))
    other = blocks.select(F.col("comp").alias("other_comp"), F.col("low").alias("other_low"), F.col("high").alias("other_high"),
                          F.col("nodes").alias("other_nodes"), F.col("cores").alias("other_cores"), F.col("flat").alias("other_flat"))
    slack = span + 1e-7
    meet = (F.col("comp") == F.col("other_comp")) & (F.col("low") - slack <= F.col("other_high")) & (F.col("other_low") <= F.col("high") + slack)
    pairs = outer.join(other, meet).select("dim", "nodes", "cores", "flat", "other_nodes", "other_cores", "other_flat")
    counted = pairs.mapInArrow(_count_blocks(threshold), "node long, n long")
    return base.unionByName(counted).groupBy("node").agg(F.sum("n").alias("n"))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, window: int = WINDOW, result: str = "links") -> DataFrame:
    """The input with a struct ``result``: n_links, component_id (of the id's type), kept."""
    names = [c for c in vectors.columns if c != result]
    numbered = vectors.select(F.monotonically_increasing_id().alias("node"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    part = {c: F.col(f"row.c{names.index(c)}") for c in (id_col, vec_col, label_col)}
    usable = linkable(part[vec_col]) & part[label_col].isNotNull()
    # written once: the numbers of the rows must not change between jobs
    stored = settle(numbered.select("node", "row", usable.alias("usable")))
    rows = stored.where("usable").select("node", part[label_col].cast("string").alias("label"), F.size(part[vec_col]).alias("dim"), part[vec_col].alias("vec"))
    comp = settle(components(candidate_links(rows, threshold, window), split=True).select("node", F.col("label").alias("comp")))
    ids = stored.select("node", part[id_col].alias("id"))
    about = settle(comp.join(ids, "node").groupBy("comp").agg(F.count("*").alias("size"), F.min("id").alias("component_id")))
    sized = settle(comp.join(about, "comp"))
    members = sized.join(rows, "node").select("comp", "node", "dim", "vec", "size")
    small = members.where(F.col("size") <= SMALL).repartition("comp").sortWithinPartitions("comp", "node")
    counts = small.select("comp", "node", "dim", "vec").mapInArrow(_count_small(threshold), "node long, n long")
    if not about.where(F.col("size") > SMALL).isEmpty():
        large = settle(members.where(F.col("size") > SMALL).drop("size"))
        counts = counts.unionByName(_count_large(large, threshold))
    linked = settle(counts.join(sized.select("node", "component_id"), "node"))
    out = stored.join(linked, "node", "left")
    least = F.coalesce(F.col("component_id"), part[id_col])
    kept = F.coalesce(part[id_col] == least, least.isNull())
    links = F.struct(F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), kept.alias("kept"))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], links.alias(result))
