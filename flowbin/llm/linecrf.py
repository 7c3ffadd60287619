"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is a position of the chain; its hidden label is good or bad.  The
score of a label is linear in the features of the line and of its two neighbours, and
neighbouring labels have a transition score.  Forward-backward gives each line's
probability of being good; the document's score is their mean, weighted by line length.

Training takes the document's label for each of its lines.  It fits on a bounded sample,
``TRAIN_DOCS`` labelled documents of least hashed id, whose line features the executors make
and the driver collects; the fit is full-batch gradient ascent with momentum estimates (Adam).
Scoring runs over whole texts in the tasks.

Defined results: a null or empty text, or one without words, has no lines and gets the
share of good documents in the training sample (0.5 without any); a document labelled more
than once has the label of the mean, good from 0.5 on; null labels and labels of unknown
documents teach nothing; without any labelled document all scores are 0.5; repeated rows have
equal results.  Further columns pass through, whatever their names.
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
from flowbin.llm.frames import pack

TRAIN_DOCS = 4000
STEPS = 200
RATE = 0.05
PENALTY = 1e-3
_NEWLINE = scan.separators(b"\n")
_CLASSES = {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "symbol": b"#*$%&<>@^~_=+\\", "bar": b"|",
            "shout": b"!", "stop": b".,;:?", "quote": b"\"'()[]{}", "high": bytes(range(128, 256))}
N_FEATURES = 18


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, length in bytes and features of every line with a word."""
    w = scan.words(data, offsets)
    line = scan.words(data, offsets, _NEWLINE)
    bound = np.searchsorted(w.start, np.append(line.start, len(data)))
    n_words = np.diff(bound)
    full = n_words > 0
    start, end, first, n_words, row = line.start[full], line.end[full], bound[:-1][full], n_words[full], line.row[full]
    n = len(start)
    if n == 0:
        return row, np.zeros(0), np.zeros((0, N_FEATURES), np.float32)
    size = (end - start).astype(np.float64)
    share = {}
    for name, members in _CLASSES.items():
        total = np.concatenate([[0], np.cumsum(scan.separators(members)[data], dtype=np.int64)])
        share[name] = (total[end] - total[start]) / size
    h = w.hashes()
    of = np.repeat(np.arange(n), n_words)  # the line of each word; lines without words have none
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=n)
    adjacent = np.bincount(of, weights=same, minlength=n)
    key = scan.span_hash(h, first, first + n_words)
    order = np.lexsort((key, row))
    again = np.zeros(n, bool)
    again[order[1:]] = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    letters = share["upper"] + share["lower"]
    last = data[np.minimum(w.end[first + n_words - 1] - 1, len(data) - 1)]
    features = np.stack([
        np.log1p(size) / 5, np.log1p(n_words) / 4, size / n_words / 10, share["upper"] / np.maximum(letters, 0.01), share["lower"], share["digit"] * 5,
        share["symbol"] * 5, np.minimum(share["bar"] * 20, 3), np.minimum(share["shout"] * 10, 3), share["stop"] * 10, share["quote"] * 5, share["high"],
        distinct / n_words, adjacent / n_words, again.astype(float), (last == ord(".")).astype(float), (n_words < 4).astype(float), np.ones(n)], axis=1)
    return row, size, features.astype(np.float32)


def with_neighbours(row: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Features of each line beside those of the line before and after (0 at the ends)."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    same = (row[1:] == row[:-1])[:, None]
    before[1:] = features[:-1] * same
    after[:-1] = features[1:] * same
    return np.concatenate([features, before, after], axis=1)


def chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each row that has any, longest first."""
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(row)))
    order = np.argsort(-size, kind="stable")
    return start[order], size[order]


def forward_backward(node: np.ndarray, step: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Marginals (lines x 2) and pair marginals summed (2 x 2), all chains in step.

    node: score of each line and label; step: transition scores.  Log-sum over two labels.
    """
    alpha, beta = node.copy(), np.zeros_like(node)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    for t in range(1, longest):
        at = start[: alive[t]] + t
        before = alpha[at - 1]
        alpha[at] += np.logaddexp(before[:, :1] + step[0], before[:, 1:] + step[1])
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        after = node[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
    both = alpha + beta
    whole = np.logaddexp(both[:, 0], both[:, 1])
    single = np.exp(both - whole[:, None])
    inner = np.ones(len(node), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] + step[None] + (node[at] + beta[at])[:, None, :] - whole[at][:, None, None]
    return single, np.exp(pair).sum(0), whole


@dataclass
class Model:
    """Weights of the good label over line features (the bad label scores 0), transitions, prior."""

    weight: np.ndarray
    step: np.ndarray
    prior: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of every row: the length-weighted mean of its lines' probabilities."""
        n = len(offsets) - 1
        row, size, features = lines(data, offsets)
        x = with_neighbours(row, features).astype(np.float64)
        node = np.stack([np.zeros(len(x)), x @ self.weight], axis=1)
        start, count = chains(row)
        good = forward_backward(node, self.step, start, count)[0][:, 1]
        total = np.bincount(row, weights=size, minlength=n)
        return np.where(total > 0, np.bincount(row, weights=size * good, minlength=n) / np.maximum(total, 1), self.prior).clip(0.0, 1.0)


def fit(row: np.ndarray, features: np.ndarray, label: np.ndarray, prior: float) -> Model:
    """Maximise the chains' likelihood; label: of each line (that of its document).

    Each document counts once: its gradient is divided by its number of lines.
    """
    x = with_neighbours(row, features).astype(np.float64)
    start, size = chains(row)
    share = 1.0 / np.bincount(row)[row]
    inner = np.ones(len(row), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at - 1], label[at]), 1.0 / len(row))
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, STEPS + 1):
        weight, step = params[:-4], params[-4:].reshape(2, 2)
        node = np.stack([np.zeros(len(x)), x @ weight], axis=1)
        single, pair, _ = forward_backward(node, step, start, size)
        up = np.concatenate([x.T @ (share * (label - single[:, 1])) / max(len(size), 1), (seen - pair / len(row)).ravel()]) - PENALTY * params
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up * up
        params = params + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(params[:-4], params[-4:].reshape(2, 2), prior)


_LINES = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("features", T.BinaryType())])


def _emit_lines(schema: pa.Schema):
    def run(batches):
        for b in scan.slices(batches, "text"):
            row, _, features = lines(*scan.buffers(b.column("text")))
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            blobs = [features[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(blobs, pa.binary())], schema=schema)

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``train_docs`` labelled documents."""
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    known = known.groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg((F.avg(f"`{label_col}`") >= 0.5).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(train_docs)  # the bound makes it fit to broadcast
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.join(F.broadcast(drawn), "id").select("id", "label", "text")
    sample = sorted(rows.mapInArrow(_emit_lines(to_arrow_schema(_LINES)), _LINES).collect(), key=lambda r: (r.id, r.features))
    if not sample:
        return Model(np.zeros(3 * N_FEATURES), np.zeros((2, 2)), 0.5)
    parts = [np.frombuffer(r.features, np.float32).reshape(-1, N_FEATURES) for r in sample]
    count = [len(p) for p in parts]
    row = np.repeat(np.arange(len(parts)), count)
    label = np.repeat(np.array([r.label for r in sample]), count)
    prior = float(np.mean([r.label for r in sample]))
    if not len(row):
        return Model(np.zeros(3 * N_FEATURES), np.zeros((2, 2)), prior)
    return fit(row, np.concatenate(parts), label, prior)


def _score(shared, schema: pa.Schema):
    def run(batches):
        for b in scan.slices(batches, "text"):
            scores = shared.value.scores(*scan.buffers(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), b.column("rest"), pa.array(scores)], schema=schema)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a double column ``quality_score``."""
    packed = pack(docs, id_col, text_col, "quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    out = T.StructType([*packed.rows.schema.fields, T.StructField("score", T.DoubleType())])
    return packed.unpack(packed.rows.mapInArrow(_score(shared, to_arrow_schema(out)), out), F.col("score"))
