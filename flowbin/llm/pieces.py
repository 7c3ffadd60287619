"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding.

The automaton holds all normal pieces.  A text is read once; at each position the output
links give every piece that ends there, longest first, and each relaxes the best score of
its end from that of its start.  A character that no piece covers alone costs the least
score less ``UNKNOWN_PENALTY`` and is written as byte pieces (else as the unknown piece).
Of equal scores the longest last piece wins.

The work is vectorised: the texts of a slice are cut where no piece can span the cut
(before a space, and round characters that are in no piece), equal segments are encoded
once, and all segments advance through the automaton in step.

Normalisation is that of an identity model with a dummy prefix: a space goes before the
text and spaces are written as U+2581.  ``decode(encode(t)) == t`` for every text without
U+2581, which reads back as a space.

Defined results: null and empty texts have no pieces and decode to the empty text; repeated
rows have equal results; further columns pass through, whatever their names.
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

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
SPACE = 0x2581


@dataclass
class Automaton:
    """States are numbered in breadth-first order, 0 is the root; all arrays are by state but the edges."""

    code: np.ndarray  # number of each code point of the vocabulary, or -1
    width: int  # numbers in use
    edge: np.ndarray  # sorted keys state * width + number
    to: np.ndarray
    fail: np.ndarray
    depth: np.ndarray
    piece: np.ndarray  # piece that ends here, or -1
    link: np.ndarray  # next state on the failure path where a piece ends (0: none)
    score: np.ndarray  # by piece
    byte: np.ndarray  # the 256 byte pieces, or empty
    unknown: int
    least: float
    cut: bool  # no piece goes on over a space
    data: bytes  # decoded bytes of all pieces
    offset: np.ndarray

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Follow one character from each state (char: its number, or -1)."""
        out = np.zeros(len(state), np.int64)
        todo = np.flatnonzero(char >= 0)
        at = state[todo]
        while len(todo):
            key = at * self.width + char[todo]
            slot = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[slot] == key
            out[todo[hit]] = self.to[slot[hit]]
            stay = ~hit & (at != 0)
            todo, at = todo[stay], self.fail[at[stay]]
        return out


def build(model_path: str = MODEL) -> Automaton:
    """The automaton of a model file (about 32,000 pieces: a second on the driver)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.vocab_size()
    text = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if text[i] and not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    chars = np.array(sorted({ord(c) for i in plain for c in text[i]}), np.int64)
    index = {int(c): k for k, c in enumerate(chars)}
    width = len(chars)
    code = np.full(int(chars.max()) + 1, -1, np.int64)
    code[chars] = np.arange(width)
    edges: dict[int, int] = {}
    depth, piece, parent, via = [0], [-1], [0], [0]
    level = {0: [(0, i) for i in plain]}
    d = 0
    while level:  # breadth first, so that states are numbered by depth
        after: dict[int, list] = {}
        for state, members in level.items():
            for _, i in members:
                if len(text[i]) == d:
                    piece[state] = i
                    continue
                key = state * width + index[ord(text[i][d])]
                to = edges.get(key)
                if to is None:
                    to = edges[key] = len(depth)
                    depth.append(d + 1)
                    piece.append(-1)
                    parent.append(state)
                    via.append(index[ord(text[i][d])])
                after.setdefault(to, []).append((to, i))
        level, d = after, d + 1
    states = len(depth)
    fail, link = np.zeros(states, np.int64), np.zeros(states, np.int64)
    for s in range(1, states):
        if depth[s] > 1:
            f = int(fail[parent[s]])
            while True:
                to = edges.get(f * width + via[s])
                if to is not None:
                    fail[s] = to
                    break
                if f == 0:
                    break
                f = int(fail[f])
        link[s] = fail[s] if piece[fail[s]] >= 0 else link[fail[s]]
    keys = np.array(sorted(edges), np.int64)
    score = np.array([model.get_score(i) for i in range(n)])
    byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    has_bytes = all(model.is_byte(int(i)) for i in byte)
    space = chr(SPACE)
    cut = not any(space in text[i].lstrip(space) for i in plain)
    decoded = [bytes([int(text[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else text[i].replace(space, " ").encode() for i in range(n)]
    return Automaton(code, width, keys, np.array([edges[int(k)] for k in keys]), fail, np.array(depth), np.array(piece), link, score,
                     byte if has_bytes else np.zeros(0, np.int64), model.unk_id(), float(score[plain].min()), cut,
                     b"".join(decoded), np.concatenate([[0], np.cumsum([len(x) for x in decoded])]))


def viterbi(a: Automaton, char: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Best pieces of every segment char[first : first + size], all segments in step.

    Returns tokens (piece, or -1 for an uncovered character), their end positions, and counts.
    """
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    base = np.cumsum(size + 1) - size - 1  # place of each segment's scores
    total = int((size + 1).sum())
    best = np.full(total, -np.inf)
    best[base] = 0.0
    back = np.zeros(total, np.int32)
    token = np.full(total, -1, np.int32)
    state = np.zeros(len(size), np.int64)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # segments of at least t characters
    unknown = a.least - UNKNOWN_PENALTY
    for t in range(longest):
        k = int(alive[t])
        state = a.step(state[:k], char[first[:k] + t])
        end = base[:k] + t + 1
        best[end] = best[end - 1] + unknown
        back[end] = 1
        out = np.where(a.piece[state] >= 0, state, a.link[state])
        on = np.flatnonzero(out)
        out = out[on]
        while len(on):
            p, length = a.piece[out], a.depth[out]
            to = end[on]
            value = best[to - length] + a.score[p]
            better = (value > best[to]) | (token[to] < 0) & (length == 1)
            to, p, length, value = to[better], p[better], length[better], value[better]
            best[to], token[to], back[to] = value, p, length
            out = a.link[out]
            more = out > 0
            on, out = on[more], out[more]
    # backwards, again in step
    seg, at = np.arange(len(size)), size.copy()
    parts = []
    live = at > 0
    seg, at = seg[live], at[live]
    while len(seg):
        place = base[seg] + at
        parts.append((seg, token[place].astype(np.int64), at))
        at = at - back[place]
        live = at > 0
        seg, at = seg[live], at[live]
    count = np.zeros(len(size), np.int64)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    seg, tok, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    seg = order[seg]
    by = np.lexsort((end, seg))
    return tok[by], end[by], np.bincount(seg, minlength=len(size))


def segments(a: Automaton, points: np.ndarray, offsets: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Starts of the pieces of text that can be encoded on their own."""
    new = np.zeros(len(points) + 1, bool)
    new[offsets[:-1]] = True
    if a.cut:
        space = points == SPACE
        new[1:-1] |= space[1:] & ~space[:-1]
    alone = np.flatnonzero(char < 0)
    new[alone] = True
    new[alone + 1] = True
    return np.flatnonzero(new[:-1])


def encode_slice(a: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of the rows of a slice: flat ids, offsets by row, score of each row."""
    rows = len(offsets) - 1
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # code points before each row
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    full = np.flatnonzero(np.diff(lead) > 0)  # rows with a text get the dummy prefix
    points = np.insert(np.where(points == 0x20, SPACE, points), lead[full], SPACE)
    lead = lead + np.searchsorted(full, np.arange(rows + 1))
    if len(points) == 0:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64), np.zeros(rows)
    char = np.where(points < len(a.code), a.code[np.minimum(points, len(a.code) - 1)], -1)
    start = segments(a, points, np.append(lead[:-1][full], len(points)), char)
    end = np.append(start[1:], len(points))
    hashed = scan.mix(points.astype(np.uint64), 51)
    h1, h2 = scan.span_hash(hashed, start, end), scan.span_hash(hashed, start, end, 1)
    _, pick, same = np.unique(h1 ^ scan.mix(h2, 52), return_index=True, return_inverse=True)
    tok, stop, count = viterbi(a, char, start[pick], (end - start)[pick])
    # uncovered characters as byte pieces
    seg = np.repeat(np.arange(len(pick)), count)
    score = np.where(tok >= 0, a.score[np.maximum(tok, 0)], a.least - UNKNOWN_PENALTY)
    score = np.bincount(seg, weights=score, minlength=len(pick))
    bad = np.flatnonzero(tok < 0)
    if len(bad):
        raw = [chr(c).encode() for c in points[start[pick][seg[bad]] + stop[bad] - 1].tolist()]
        ids = [a.byte[list(r)] if len(a.byte) else np.array([a.unknown]) for r in raw]
        width = np.ones(len(tok), np.int64)
        width[bad] = [len(x) for x in ids]
        flat = np.repeat(tok, width)
        flat[flat < 0] = np.concatenate(ids)
        count = np.bincount(seg, weights=width, minlength=len(pick)).astype(np.int64)
        tok = flat
    at = np.cumsum(count) - count
    n = count[same]
    ids = tok[np.repeat(at[same], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    row = np.searchsorted(lead, start, "right") - 1
    by_row = np.concatenate([[0], np.cumsum(np.bincount(row, weights=n, minlength=rows).astype(np.int64))])
    return ids, by_row, np.bincount(row, weights=score[same], minlength=rows)


def decode_slice(a: Automaton, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of rows of piece ids; the dummy prefix goes."""
    table = np.frombuffer(a.data, np.uint8)
    n = np.diff(a.offset)[ids]
    at = np.concatenate([[0], np.cumsum(n)])
    data = table[np.repeat(a.offset[ids] - at[:-1], n) + np.arange(at[-1])] if len(ids) else table[:0]
    cut = at[offsets]
    return [x[1:] if x.startswith(" ") else x for x in (data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(cut[:-1], cut[1:], strict=True))]


_IDS = T.ArrayType(T.IntegerType())


def _encode(shared, schema: pa.Schema, check: bool):
    """Pieces of every text, with ``check`` decoded again by the same worker."""
    def run(batches):
        a = shared.value
        for b in scan.slices(batches, "text"):
            ids, by_row, score = encode_slice(a, *scan.buffers(b.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(by_row, pa.int32()), pa.array(ids, pa.int32()))
            again = [pa.array(decode_slice(a, ids, by_row), pa.string())] if check else []
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), b.column("rest"), lists, pa.array(score), *again], schema=schema)

    return run


def _decode(shared, schema: pa.Schema):
    def run(batches):
        a = shared.value
        for b in batches:
            for begin in range(0, b.num_rows, 512):
                part = b.slice(begin, 512)
                column = part.column("ids")
                n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = decode_slice(a, column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "text", "rest", "ids", "score")], pa.array(texts, pa.string())], schema=schema)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, check: bool = False) -> DataFrame:
    """``docs`` with a struct ``pieces``: ids (array<int>), score, and, with ``check``, decoded."""
    packed = pack(docs, id_col, text_col, "pieces")
    shared = docs.sparkSession.sparkContext.broadcast(build(model_path))  # a vocabulary: a few MB
    new = [T.StructField("ids", _IDS), T.StructField("score", T.DoubleType()), *[T.StructField("decoded", T.StringType())] * check]
    out = T.StructType([*packed.rows.schema.fields, *new])
    frame = packed.rows.mapInArrow(_encode(shared, to_arrow_schema(out), check), out)
    return packed.unpack(frame, F.struct(*[f.name for f in new]))


def decode(frame: DataFrame, ids_col: str = "ids", into: str = "text", model_path: str = MODEL) -> DataFrame:
    """``frame`` with the text of its piece ids as column ``into``."""
    shared = frame.sparkSession.sparkContext.broadcast(build(model_path))
    others = [c for c in frame.columns if c != into]
    rows = frame.select(F.lit(0).cast("long").alias("id"), F.lit("").alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("fill")).alias("rest"),
                        F.col(f"`{ids_col}`").cast(_IDS).alias("ids"), F.lit(0.0).alias("score"))
    out = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    done = rows.mapInArrow(_decode(shared, to_arrow_schema(out)), out)
    return done.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(others)], F.col("decoded").alias(into))
