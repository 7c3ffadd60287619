"""Near duplicates, substring dedup and components against brute force, and their odd inputs."""

import collections
import itertools
import random

import numpy as np
import pytest

from flowbin.llm import orderminhash, substrings
from flowbin.llm.components import components
from llm_brute import brute_classes, brute_common, brute_repeats


def test_alignment_is_exact_from_the_threshold_on():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        b = [rng.randrange(6) if rng.random() < 0.1 else x for x in a if rng.random() > 0.05] or [1]
        c = brute_common(a, b)
        s = c / (len(a) + len(b) - c)
        got = orderminhash.similarity(a, b)
        assert (got >= 0.8) == (s >= 0.8)
        assert s < 0.8 or abs(got - s) < 1e-12


@pytest.fixture(scope="module")
def small_docs():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    docs = []
    for k, words in enumerate(base):
        for _ in range(rng.randrange(1, 6)):
            new = [rng.choice(vocabulary) if rng.random() < 0.04 else w for w in words]
            docs.append(" ".join(new))
        docs.append(" ".join(words[:20] + passage + words[40:]))
    docs += [docs[0], docs[0], "  ".join(docs[3].split(" ")), "", None, "one two three", "one two three", " \n "]
    return list(enumerate(docs))


def test_near_classes_equal_all_pairs(spark, small_docs):
    df = spark.createDataFrame(small_docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in orderminhash.classes(df).collect()}
    assert got == brute_classes(small_docs)


def test_near_copies_of_a_large_group_and_shared_passage(spark):
    rng = random.Random(9)
    words = [f"a{rng.randrange(300)}" for _ in range(100)]
    docs = []
    for i in range(120):  # one group of copies with one word changed
        new = list(words)
        new[rng.randrange(100)] = f"x{i}"
        docs.append((i, " ".join(new)))
    for i in range(120, 240):  # a passage in common is not enough
        docs.append((i, " ".join(words[:40] + [f"b{rng.randrange(10**6)}" for _ in range(40)])))
    got = {r.doc_id: r.class_id for r in orderminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(120))
    assert all(got[i] == i for i in range(120, 240))


def test_near_pairs_within_a_template_of_thousands(spark):
    rng = random.Random(21)
    template = [f"t{i}" for i in range(85)]
    fresh = iter(range(10**6))
    docs = []
    for i in range(1000):  # the template alone is not enough; a pair has six more words in common
        shared = [f"s{i}_{j}" for j in range(6)]
        for _ in range(2 if i < 200 else 1):
            docs.append(" ".join(template + shared + [f"u{next(fresh)}" for _ in range(9)]))
        docs.append(" ".join(template + [f"u{next(fresh)}" for _ in range(15)]))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    sets = [frozenset(t.split()) for _, t in docs]
    want = {i: i for i, _ in docs}
    often = collections.Counter(x for one in sets for x in one)
    names = {x: k for k, x in enumerate(x for x, n in often.items() if n > 1)}
    held = np.zeros((len(docs), len(names)), np.float32)
    for i, one in enumerate(sets):
        held[i, [names[x] for x in one if x in names]] = 1
    both, size = held @ held.T, np.array([len(x) for x in sets])
    # no word occurs twice in a text, so that no more than those in common can be aligned
    for i, j in np.argwhere(np.triu(both >= 0.8 * (size[:, None] + size - both), 1)).tolist():
        if brute_classes([docs[i], docs[j]])[j] == i:
            want[j] = want[i]
    assert sum(i != c for i, c in want.items()) == 200
    got = {r.doc_id: r.class_id for r in orderminhash.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_recall_of_word_edits_on_the_table(spark):
    """Pairs of documents by word similarity from 0.8 on, all pairs against the classes."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = brute_classes(docs)
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in orderminhash.classes(frame).collect()}
    assert set(got) == set(want)
    members = collections.defaultdict(list)
    for i, c in want.items():
        members[c].append(i)
    assert all(want[i] == want[c] for i, c in got.items())  # no class joins what all pairs keep apart
    pairs = [(i, j) for ids in members.values() for k, i in enumerate(ids) for j in ids[k + 1 :]]
    assert len(pairs) > 100 and sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)


def test_texts_that_share_a_name_are_told_apart(spark):
    rows = [(1, 7, 10, 3, [1]), (2, 7, 10, 3, [1]), (3, 7, 11, 3, [2]), (4, 8, 12, 3, [3]), (5, None, None, 0, None)]
    frame = spark.createDataFrame(rows, "id long, node long, proof long, size long, keys array<long>")
    got = {r.id: r.node for r in orderminhash._told_apart(frame).collect()}
    assert got[1] == got[2] == 7 and got[3] not in (7, 8) and got[4] == 8 and got[5] is None


def test_keep_first_keeps_one_of_each_class_and_all_columns(spark, small_docs):
    rows = [(i, t, "x", i * 2) for i, t in small_docs] + [(0, small_docs[0][1], "x", 0), (None, "lonely text of a row without id", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, near long")
    out = orderminhash.keep_first(df)
    assert out.columns == ["doc_id", "text", "node"]
    classes = brute_classes(small_docs)
    want = {i for i, c in classes.items() if i == c}
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert got.count(None) == 1


def test_near_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert orderminhash.classes(df).count() == 0
    assert orderminhash.keep_first(df).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[100 + i] for i in range(30)} == {100}
    assert got[200] == got[201] == 200


def repeats(spark, docs, extra=False):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = substrings.remove_repeats(df)
    rows = out.select("doc_id", "repeats.n_words", "repeats.n_removed", substrings.word_digest(out["text"])).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_substrings_equal_brute_force_with_runs_and_ties(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "der", "und", "x1", "x2", "é"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            r = rng.random()
            if r < 0.3:
                parts += [rng.choice(vocabulary)] * rng.randrange(1, 40)
            elif r < 0.7:
                a = rng.randrange(40)
                parts += passage[a : a + rng.randrange(5, 40)]
            else:
                parts += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))]
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    docs += [(81, docs[4][1]), (2, docs[5][1]), (2, docs[5][1]), (90, None), (91, ""), (None, docs[5][1]), (92, "  " + " ".join(passage) + "\n")]
    assert repeats(spark, docs) == brute_repeats(docs)


def test_substrings_long_text_spans_and_clashing_columns(spark):
    long = " ".join(f"t{i % 5000}" for i in range(12000))
    docs = [(1, long, 5, "q"), (2, "start " + " ".join(f"t{i}" for i in range(100, 140)) + " end", 6, "r")]
    df = spark.createDataFrame(docs, "doc_id long, text string, repeats long, id string")
    out = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert out[1].repeats.n_removed == 0 and out[1].text == long and out[1].id == "q"
    assert out[2].text == "start end" and [tuple(s) for s in out[2].repeats.spans] == [(1, 41)]


def test_substrings_of_empty_table(spark):
    assert repeats(spark, []) == []


def test_owned_tables_go_and_others_stay(spark):
    from flowbin.llm.frames import delete, owned, settle

    free = settle(spark.range(3).toDF("x"))
    with owned() as paths:
        mine = settle(spark.range(4).toDF("x"))
        with owned() as inner:
            settle(spark.range(5).toDF("x"))
    assert len(paths) == len(inner) == 1 and mine.count() == 4
    delete(spark, paths)
    assert free.count() == 3 and paths == []
    with pytest.raises(Exception):
        mine.collect()


def test_marks_never_differ_more_than_the_words_do():
    import pyarrow as pa

    from flowbin.llm import textscan as scan

    rng = random.Random(31)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 5, 80, 900]))) for _ in range(60)] + ["", " "]
    w = scan.words(*scan.buffers(pa.array(texts)))
    found = orderminhash.marks(w.row, orderminhash._labels(w), w.rows).view(np.uint64)
    assert found.shape == (len(texts), orderminhash.MARKS) and not found[-2:].any()
    bags = [collections.Counter(t.split()) for t in texts]
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            apart = sum(int(x).bit_count() for x in found[i] ^ found[j])
            assert apart <= a.total() + b.total() - 2 * (a & b).total()


def _noisy(rng, words, share, fresh):
    return [f"n{next(fresh)}" if rng.random() < share else w for w in words]


def test_pairs_of_a_bucket_are_found_once_in_cells_of_all_sizes(spark, monkeypatch):
    """Near pairs across tiers, blocks, classes and buckets against all pairs; each comes once."""
    monkeypatch.setattr(orderminhash, "BLOCK", 7)
    rng, fresh = random.Random(41), iter(range(10**6))
    docs = []
    for n in (1, 3, 58, 64, 65, 70, 128, 140, 257, 600):  # 64 << k words end a tier
        words = [f"t{n}_{rng.randrange(4 * n)}" for _ in range(n)]
        for _ in range(9):
            new = _noisy(rng, words, rng.choice([0, 0.03, 0.06, 0.2]), fresh)
            docs.append(new + [f"e{next(fresh)}" for _ in range(rng.randrange(1 + n // 8))])
    rng.shuffle(docs)
    docs = {k: words for k, words in enumerate(docs)}
    label = {k: k if rng.random() < 0.5 else -1 for k in docs}
    buckets = {k: set(rng.sample([11, -5, 8], rng.randrange(1, 4))) for k in docs}
    rows = [(b, k, label[k]) for k in docs for b in sorted(buckets[k])]
    open_ = spark.createDataFrame(rows, "bucket long, node long, label long")
    text = spark.createDataFrame([(k, " ".join(words)) for k, words in docs.items()], "node long, text string")
    got = [(r.a, r.b) for r in orderminhash._rest(open_, text, 0.8).collect()]
    assert len(got) == len(set(got)) and all(a < b and label[a] != label[b] and buckets[a] & buckets[b] for a, b in got)
    want = set()
    for a in docs:
        for b in docs:
            if a < b and label[a] != label[b] and buckets[a] & buckets[b]:
                if orderminhash.similarity(docs[a], docs[b]) >= 0.8:
                    want.add((a, b))
    assert len(want) > 50 and want <= set(got)


def test_long_texts_with_a_passage_in_common_are_not_aligned(spark):
    """Marks grow with the texts: 256 bits let every pair of these pass."""
    rng = random.Random(43)
    passage = [f"p{i}" for i in range(700)]
    docs = [passage + [f"w{rng.randrange(3000)}" for _ in range(800)] for _ in range(60)]
    docs += [docs[0][:-60] + [f"x{i}" for i in range(60)]]
    open_ = spark.createDataFrame([(1, k, k) for k in range(len(docs))], "bucket long, node long, label long")
    text = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(docs)], "node long, text string")
    assert [(r.a, r.b) for r in orderminhash._rest(open_, text, 0.8).collect()] == [(0, 60)]


def test_pairs_of_a_group_grow_with_its_members(spark, monkeypatch):
    """Leaders are ranked alike in all buckets, so that a group of near copies is not aligned with all of them."""
    rng, fresh = random.Random(47), iter(range(10**6))
    words = [f"g{i}" for i in range(150)]
    docs = [(i, " ".join(_noisy(rng, words, rng.choice([0.01, 0.03, 0.06, 0.09]), fresh) if i else words)) for i in range(300)]
    aligned, near = [], orderminhash._near

    def counted(pairs, text, threshold):
        aligned.append(pairs.count())
        return near(pairs, text, threshold)

    monkeypatch.setattr(orderminhash, "_near", counted)
    got = {r.doc_id: r.class_id for r in orderminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    split = [t.split() for _, t in docs]
    want = {a: a for a, _ in docs}
    for a, b in itertools.combinations(want, 2):
        if orderminhash.similarity(split[a], split[b]) >= 0.8:
            x, y = sorted((want[a], want[b]))
            want = {i: x if c == y else c for i, c in want.items()}
    assert got == want
    assert sum(aligned) <= 10 * len(docs), aligned
