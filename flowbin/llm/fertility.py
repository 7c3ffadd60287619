"""Quality rules by tokeniser fertility.

Public vocabularies measure each whole text: characters per token of a piece model and of a
byte-level model, the piece model's share of byte-fallback tokens, and the entropy of its
tokens in bits.  Text unlike the running prose of its language (symbol noise, shouting, lists,
repetition, broken encodings) needs more tokens, or fewer different ones.

The rejection bands lie round the median of a group's documents that pass the base rules:
``REACH`` spreads to either side, a spread being the median distance from the median (scaled
to a standard deviation, at least ``LEAST_SPREAD`` of the median).  Equal documents, told by
their counts and measures, vote once, and neither median moves much while less than half of
the different documents are junk, so neither copies nor a large junk source open the bands.
Characters per token have both fences, entropy the lower, byte share the upper.  The group is
the language column's value, else the script of most letters.

The base rules: fewer than ``LEAST_WORDS`` words, or more than half of them in three-word
windows that recur.

Defined results: a null or empty text has no words or tokens, its measures are null and it
fails the base rules; a null language falls back on the script; repeated rows have equal
results; a group of one document accepts it.  Further columns pass through, whatever their
names.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbin.llm import textscan as scan
from flowbin.llm.frames import pack, settle

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAST_WORDS = 50
REACH = 3.9
LEAST_SPREAD = 0.005
NORMAL = 1.4826  # median distance to standard deviation, of a normal distribution
BROADCAST_GROUPS = 10_000
SYMBOLS = scan.separators(b"#*$%&|<>")
MEASURES = ("chars_per_token", "bytes_chars_per_token", "fallback_share", "entropy")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# script blocks of the Unicode standard by first code point (fixed values)
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"),
           (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def base_counts(w: scan.Words) -> dict[str, np.ndarray]:
    """The five base counts of each row."""
    data, n = w.data, w.rows
    lead = (data & 0xC0) != 0x80
    edge = np.zeros(len(data) + 1, np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1
    in_word = np.cumsum(edge[:-1]).astype(bool)
    out = {"n_words": w.counts, "word_chars": _per_row(lead & in_word, w.offsets), "n_symbols": _per_row(SYMBOLS[data], w.offsets)}
    # lines with a word that equal an earlier one of the row
    line = scan.words(data, w.offsets, scan.separators(b"\n"))
    held = np.diff(np.searchsorted(w.start, np.append(line.start, len(data)))) if len(line.start) else np.zeros(0, np.int64)
    full = held > 0
    key, row = line.hashes()[full], line.row[full]
    order = np.lexsort((key, row))
    again = np.zeros(len(order), bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][again], minlength=n)
    # words under three-word windows that occur twice or more in the row
    at, key = scan.windows(w, w.hashes(), 3)
    row = w.row[at]
    order = np.lexsort((key, row))
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    many = np.zeros(len(order), bool)
    many[1:] |= same
    many[:-1] |= same
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, at[order][many], 1)
    np.add.at(edge, at[order][many] + 3, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(edge[:-1]) > 0, w.first)
    return out


def scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The script of most non-ASCII or ASCII letters of each row ('none' without letters)."""
    names = sorted({s for _, s in SCRIPTS})
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != len(lead):
        return ["none"] * (len(offsets) - 1)
    slot = np.searchsorted([p for p, _ in SCRIPTS], points, "right") - 1
    kind = np.array([names.index(s) for _, s in SCRIPTS])[np.maximum(slot, 0)]
    letter = ((points | 32) >= 97) & ((points | 32) <= 122) | (points >= 0xAA)
    row = np.searchsorted(offsets, lead[letter], "right") - 1
    count = np.zeros((len(offsets) - 1, len(names)), np.int64)
    np.add.at(count, (row, kind[letter]), 1)
    return [names[i] if c else "none" for i, c in zip(count.argmax(1), count.max(1), strict=True)]


@functools.lru_cache(2)
def _piece_model(proto: bytes):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())])


@functools.lru_cache(2)
def _byte_model(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_measures(texts: list[str], proto: bytes, ranks: bytes, pattern: str) -> dict[str, np.ndarray]:
    """The four measures of each text; NaN without tokens."""
    model, is_byte = _piece_model(proto)
    other = _byte_model(ranks, pattern)
    n = len(texts)
    ids = [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)] if n else []
    size = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *ids])
    row = np.repeat(np.arange(n), size)
    byte = np.bincount(row[is_byte[flat]], minlength=n)
    kind, count = np.unique(row * len(is_byte) + flat, return_counts=True)
    kind //= len(is_byte)
    share = count / np.maximum(size, 1)[kind]
    entropy = np.bincount(kind, weights=-share * np.log2(share), minlength=n)
    chars = np.array([len(x) for x in texts], np.int64)
    others = np.array([len(other.encode_ordinary(x)) for x in texts], np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        values = (chars / size, chars / others, byte / size, np.where(size > 0, entropy, np.nan))
    return {k: np.where(np.isfinite(v), v, np.nan) for k, v in zip(MEASURES, values, strict=True)}


def _measure(shared, keep_text: bool, schema: pa.Schema):
    def run(batches):
        proto, ranks, pattern = shared.value
        for b in scan.slices(batches, "text"):
            data, off = scan.buffers(b.column("text"))
            w = scan.words(data, off)
            counts = base_counts(w)
            texts = ["" if x is None else x for x in b.column("text").to_pylist()]
            measures = token_measures(texts, proto, ranks, pattern)
            lang = b.column("lang")
            if lang.null_count:
                lang = pc.coalesce(lang, pa.array(scripts(data, off), lang.type))
            columns = [b.column("id"), *([b.column("text")] if keep_text else []), b.column("rest"), lang]
            columns += [pa.array(counts[c], pa.int64()) for c in _COUNTS]
            columns += [pa.array(measures[c], pa.float64(), from_pandas=True) for c in MEASURES]
            yield pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def bands(measured: DataFrame) -> DataFrame:
    """Lower and upper fence of each measure by group, from exact medians over all different
    documents that pass the base rules (values counted to a thousandth)."""
    different = measured.where(~F.col("base_failed")).select("group", *MEASURES, *_COUNTS).distinct()
    long = different.select("group", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * 1000).cast("long").alias("v")) for m in MEASURES])))
    counts = settle(long.where("v IS NOT NULL").groupBy("group", "measure", "v").count())
    middle = counts.groupBy("group", "measure").agg(F.expr("percentile(v, 0.5, count)").alias("mid"))
    side = middle.select(F.col("group").alias("g"), F.col("measure").alias("m"), "mid")
    off = counts.join(side, F.col("group").eqNullSafe(F.col("g")) & (F.col("measure") == F.col("m")))
    far = off.groupBy("group", "measure").agg(F.first("mid").alias("mid"), F.expr("percentile(abs(v - mid), 0.5, count)").alias("off"))
    spread = F.greatest(NORMAL * F.col("off"), F.lit(LEAST_SPREAD) * F.col("mid"), F.lit(0.5)) * REACH
    fences = far.select("group", "measure", ((F.col("mid") - spread) / 1000).alias("low"), ((F.col("mid") + spread) / 1000).alias("high"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}")
    return fences.groupBy("group").agg(*[pick(m, c) for m in MEASURES for c in ("low", "high")])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", keep_text: bool = True,
          pieces: str = PIECES, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """``docs`` with a struct ``fertility``: base counts, base_failed, the measures, group, kept.

    ``keep_text=False`` leaves the text column out.  The measured rows are written once to the
    shared checkpoint folder, since the bands need all of them.
    """
    spark = docs.sparkSession
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    with open(pieces, "rb") as f, open(ranks, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read(), pattern))  # the two public files, under 2 MB
    packed = pack(docs, id_col, text_col, "fertility")
    rest = [c for c in docs.columns if c not in (id_col, text_col, "fertility")]
    lang = F.col(f"rest.c{rest.index(lang_col)}").cast("string") if lang_col else F.lit(None).cast("string")
    rows = packed.rows.withColumn("lang", lang)
    fields = [f for f in packed.rows.schema.fields if keep_text or f.name != "text"]
    out = T.StructType([*fields, T.StructField("group", T.StringType()), *[T.StructField(c, T.LongType()) for c in _COUNTS],
                        *[T.StructField(c, T.DoubleType()) for c in MEASURES]])
    measured = rows.mapInArrow(_measure(shared, keep_text, to_arrow_schema(out)), out)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = settle(measured.withColumn("base_failed", failed))
    fences = settle(bands(measured))
    if fences.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    both = measured.join(fences, "group", "left")
    inside = lambda m, low, high: F.coalesce(F.col(m).between(F.col(f"low_{m}") if low else F.lit(-1e300), F.col(f"high_{m}") if high else F.lit(1e300)), F.lit(False))
    verdict = inside("chars_per_token", True, True) & inside("bytes_chars_per_token", True, True) & inside("fallback_share", False, True) & inside("entropy", True, False)
    result = F.struct(*_COUNTS, "base_failed", *MEASURES, "group", (~F.col("base_failed") & verdict).alias("kept"))
    if not keep_text:
        packed.source = packed.source.drop(text_col)
    return packed.unpack(both, result)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    return judge(docs, **options).where("fertility.kept").drop("fertility")
