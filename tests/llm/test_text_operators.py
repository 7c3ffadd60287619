"""Decontamination, fertility, pieces, language id and line quality: brute force, round trips, odd inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowbin.llm import decontam, fertility, langid, linecrf, pieces
from flowbin.llm import textscan as scan
from llm_brute import brute_leaks

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def leak_case():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "Ab"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 40)))) for k in range(20)]
    items += [(20, "short one!"), (21, items[0][1]), (21, items[0][1]), (22, ""), (23, None), (None, items[2][1]), (24, "rare")]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            w = rng.choice(items[:20])[1].split()
            a = rng.randrange(len(w))
            parts += w[a : a + rng.randrange(1, 30)] + [rng.choice(vocabulary) for _ in range(rng.randrange(10))]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(60, "A SHORT, one more"), (61, None), (62, ""), (3, docs[5][1]), (None, items[0][1]), (63, "so rare"), (64, items[3][1].upper())]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 24, 700])
def test_leaks_equal_brute_force(spark, leak_case, block_bytes):
    docs, items = leak_case
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontam.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.select("doc_id", "leaks.*").collect()]
    assert sorted(got, key=str) == brute_leaks(docs, items)


def test_longest_matches_and_filter(spark):
    item = " ".join(f"i{k}" for k in range(30))
    docs = [(1, "x y " + " ".join(f"i{k}" for k in range(4, 25)) + " z"), (2, "clean words only"), (3, None)]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, leaks long")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    r = decontam.find_leaks(df, bench).where("doc_id = 1").first().leaks
    assert [tuple(m) for m in r.matches] == [(7, 4, 2, 21)] and [tuple(s) for s in r.spans] == [(2, 23)]
    kept = decontam.decontaminate(df, bench)
    assert sorted(x.doc_id for x in kept.collect()) == [2, 3]


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontam.find_leaks(none, items).count() == 0
    assert decontam.find_leaks(docs, items).first().leaks.n_hit == 0


def brute_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    mark = [False] * len(w)
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            mark[i : i + 3] = [True] * 3
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(mark)


def test_base_counts_equal_brute_force():
    rng = random.Random(4)
    texts = ["", "\n\n", "a", "é è ü\x0bx", "a b c a b c", "x # $ | <b>\nx # $ | <b>\n  \n  \n"]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "é", "#", "日", "\t"]) for _ in range(rng.randrange(200))) for _ in range(200)]
    w = scan.words(*scan.buffers(pa.array(texts)))
    got = fertility.base_counts(w)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert list(zip(*(got[n].tolist() for n in names), strict=True)) == [brute_base(t) for t in texts]


def test_token_measures_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=fertility.PIECES)
    text = "The quick brown fox Жሴ jumps\nover"
    df = spark.createDataFrame([(1, text, "en"), (2, None, None), (3, "", "en")], "doc_id long, text string, lang string")
    out = {r.doc_id: r.fertility for r in fertility.judge(df).collect()}
    ids = model.encode(text)
    counts = collections.Counter(ids)
    assert out[1].chars_per_token == pytest.approx(len(text) / len(ids))
    assert out[1].entropy == pytest.approx(-sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()))
    assert out[1].fallback_share == pytest.approx(sum(model.is_byte(i) for i in ids) / len(ids))
    assert out[2].chars_per_token is None and out[2].base_failed and not out[2].kept and out[2].group == "none"
    assert out[3].n_words == 0 and not out[3].kept


def test_bands_are_fences_of_all_documents(spark):
    """Bands and verdicts recomputed from the measures in plain Python."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("fertility", F.lit(1)).withColumn("group", F.lit("x"))
    rows = fertility.judge(docs).select("doc_id", "lang", "fertility.*").collect()
    by = collections.defaultdict(list)
    for r in rows:
        if not r.base_failed:
            by[r.lang].append(r)

    def fences(values):
        v = np.floor(np.array([x for x in values if x is not None]) * 1000 + 0.5)
        m = np.median(v)
        reach = max(fertility.NORMAL * np.median(np.abs(v - m)), fertility.LEAST_SPREAD * m, 0.5) * fertility.REACH
        return (m - reach) / 1000, (m + reach) / 1000

    for group in by.values():
        votes = {tuple(r[c] for c in (*fertility.MEASURES, *fertility._COUNTS)): r for r in group}.values()
        f = {m: fences([r[m] for r in votes]) for m in fertility.MEASURES}
        for r in group:
            want = (f["chars_per_token"][0] <= r.chars_per_token <= f["chars_per_token"][1]
                    and f["bytes_chars_per_token"][0] <= r.bytes_chars_per_token <= f["bytes_chars_per_token"][1]
                    and r.fallback_share <= f["fallback_share"][1] and r.entropy >= f["entropy"][0])
            assert r.kept == want
    assert fertility.keep_good(docs).columns == [c for c in docs.columns if c != "fertility"]


def test_fertility_keeps_the_good_and_rejects_the_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = fertility.judge(docs, keep_text=False).join(labels, "doc_id").where("NOT fertility.base_failed")
    share = {r.quality: r.kept for r in out.groupBy("quality").agg(F.avg(F.col("fertility.kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.97 and share[0] < 0.2


def test_a_junk_source_does_not_open_the_bands(spark):
    """A third of a language's documents are junk of one source, many of them copies."""
    rng = np.random.default_rng(3)
    good = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' AND length(text) BETWEEN 600 AND 4000").orderBy("doc_id").limit(150).collect()]
    junk = [" | ".join(rng.choice(list("abcdefgh"), 90)) for _ in range(40)] + [" | ".join("abcdefgh" * 12)] * 35
    rows = [(k, t, "en") for k, t in enumerate(good + junk)]
    kept = {r.doc_id for r in fertility.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(k >= len(good) for k in kept)


def test_fertility_of_an_empty_table(spark):
    assert fertility.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


@pytest.fixture(scope="module")
def automaton():
    return pieces.build()


def brute_pieces(text, automaton):
    """Viterbi over all substrings, of equal scores the longest last piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    if not hasattr(brute_pieces, "known"):
        brute_pieces.known = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    known = brute_pieces.known
    if not text:
        return []
    t = "▁" + text.replace(" ", "▁")
    best, back = [0.0], [None]
    for e in range(1, len(t) + 1):
        score, step = best[e - 1] + automaton.least - pieces.UNKNOWN_PENALTY, (e - 1, None)
        for n in range(min(16, e), 0, -1):
            p = known.get(t[e - n : e])
            if p is not None and (best[e - n] + model.get_score(p) > score or step[1] is None and n == 1):
                score, step = best[e - n] + model.get_score(p), (e - n, p)
        best.append(score)
        back.append(step)
    out, e = [], len(t)
    while e:
        s, p = back[e]
        out.append([p] if p is not None else [model.piece_to_id(f"<0x{b:02X}>") for b in t[s:e].encode()])
        e = s
    return [x for part in reversed(out) for x in part]


def test_pieces_equal_brute_force_and_round_trip(automaton):
    rng = random.Random(8)
    texts = ["", " ", "  lead and trail  ", "a\nb\tc\x00d", "日本語テスト😀é", "x" * 300, "the " * 50, "ab́c"]
    texts += ["".join(rng.choice("aeinrst  \néüß日😀<>0x") for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    ids, by, _ = pieces.encode_slice(automaton, *scan.buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[by[i] : by[i + 1]].tolist() == brute_pieces(t, automaton), t
    assert pieces.decode_slice(automaton, ids, by) == texts


def test_pieces_frame(spark):
    rows = [(1, "hello world", 3), (1, "hello world", 3), (2, None, 4), (None, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = pieces.encode(df, check=True)
    assert out.columns == ["doc_id", "text", "ids", "pieces"]
    got = out.collect()
    assert [r.pieces.decoded for r in got] == ["hello world", "hello world", "", ""]
    assert got[2].text is None and list(got[2].pieces.ids) == []
    back = pieces.decode(out.select("doc_id", F.col("pieces.ids").alias("ids")))
    assert sorted(r.text for r in back.collect()) == ["", "", "hello world", "hello world"]
    assert pieces.encode(df.limit(0)).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    protos = langid.learn(docs.where(langid.bucket("doc_id", 4) != 2))
    out = langid.predict(docs.where(langid.bucket("doc_id", 4) == 2), protos)
    right = out.agg(F.avg((F.col("language.lang") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_vectors_equal_the_definition():
    text = "Ab, éb 1a"
    row, number, count, which, n = langid.counted([text])
    got = langid.bundle(1, row, number, count, which)[0]
    clean = " ab éb a "
    want = np.zeros(langid.DIM)
    for i in range(len(clean) - 2):
        sign = np.ones(langid.DIM)
        for j in range(3):
            bits = langid.vectors(np.array([ord(clean[i + j])]))[0]
            sign *= np.roll(1.0 - 2.0 * bits, j)
        want += sign
    assert n[0] == len(clean) - 2 and np.array_equal(got, want)


def test_language_odd_inputs(spark):
    teach = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("text", None), ("123", "xx")], "text string, lang string")
    docs = spark.createDataFrame([(1, "the dog"), (2, None), (3, "12 !?"), (4, ""), (None, "die katze"), (1, "the dog")], "doc_id long, text string")
    got = {(r.doc_id, r.text): (r.language.lang, r.language.score) for r in langid.predict(docs, langid.learn(teach)).collect()}
    assert got[(1, "the dog")][0] == "en" and got[(None, "die katze")][0] == "de"
    assert all(got[k] == ("und", 0.0) for k in [(2, None), (3, "12 !?"), (4, "")])
    nothing = langid.predict(docs, langid.learn(teach.limit(0))).collect()
    assert {r.language.lang for r in nothing} == {"und"}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([4, 2, 1])
    start = np.array([0, 4, 6])
    node, step = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    single, pair, _ = linecrf.forward_backward(node, step, start, sizes)
    want, pairs = np.zeros((7, 2)), np.zeros((2, 2))
    for s, n in zip(start, sizes):
        weights = {}
        for path in np.ndindex(*[2] * n):
            weights[path] = math.exp(sum(node[s + i, y] for i, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
        z = sum(weights.values())
        for path, w in weights.items():
            for i, y in enumerate(path):
                want[s + i, y] += w / z
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w / z
    assert np.allclose(single, want) and np.allclose(pair, pairs)


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = linecrf.learn(docs, labels.where(langid.bucket("doc_id", 3) != 1))
    out = linecrf.score(docs, model).join(labels.where(langid.bucket("doc_id", 3) == 1), "doc_id")
    right = out.agg(F.avg(((F.col("quality_score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


def test_quality_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "A fine line.\nAnother one."), (2, "!!! $$$"), (3, None), (4, " \n "), (None, "x"), (1, "A fine line.\nAnother one.")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (9, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = linecrf.learn(docs, labels)
    rows = linecrf.score(docs, model).collect()
    assert all(0.0 <= r.quality_score <= 1.0 for r in rows) and len(rows) == 6
    assert {r.quality_score for r in rows if r.doc_id in (3, 4)} == {model.prior}
    assert {r.quality_score for r in linecrf.score(docs, linecrf.learn(docs, labels.limit(0))).collect()} == {0.5}
    assert linecrf.score(docs.limit(0), model).count() == 0


def test_decontamination_query_equals_brute_force(spark):
    import duckdb

    from flowbin.llm.queries import QUERIES

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF001}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF001}/benchmark.parquet'").fetchall()
    want = {i: (n, h, len(x), hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest(), h > 0) for i, n, h, x in brute_leaks(docs, items)}
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op5_decontamination"](spark, SF001).collect()}
    assert got == want


def test_every_oracle_is_sql():
    from flowbin.llm.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    assert all(isinstance(sql, str) for sql in ORACLES.values())
