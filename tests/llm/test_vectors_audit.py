"""Sorted projection passes, filtered integer k-means and the trie audit against brute force, and odd inputs."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbin.llm import centroids, sortedpasses, texttries
from flowbin.llm.texttries import Trie, adaptive_cuts, text_mask
from llm_brute import WORDS


def brute_links(rows, threshold=0.93):
    """Row number -> (links, least id of the component); rows are (id, vector, label)."""
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = collections.defaultdict(set)
    for key in {(rows[k][2], len(rows[k][1])) for k in good}:
        own = [k for k in good if (rows[k][2], len(rows[k][1])) == key]
        units = np.array([rows[k][1] for k in own], float)
        units /= np.abs(units).max(axis=1, keepdims=True)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(units @ units.T >= threshold), strict=True):
            if a != b:
                links[own[a]].add(own[b])
    out, seen = {}, set()
    for start in range(len(rows)):
        if start in seen:
            continue
        group, todo = [], [start]
        seen.add(start)
        while todo:
            x = todo.pop()
            group.append(x)
            todo += [y for y in links[x] if y not in seen]
            seen |= links[x]
        ids = [rows[x][0] for x in group if rows[x][0] is not None]
        for x in group:
            out[x] = (len(links[x]), min(ids) if ids else None)
    return out


def check_links(spark, rows, **options):
    """The operator's rows equal brute force; rows are told apart by a further column."""
    table = spark.createDataFrame([(i, v, label, k) for k, (i, v, label) in enumerate(rows)], "vec_id long, embedding array<double>, label int, node int")
    got = {r.node: (r.links.n_links, r.links.component_id, r.links.kept) for r in sortedpasses.link_vectors(table, **options).collect()}
    want = brute_links(rows)
    assert set(got) == set(want)
    for k, (n, least) in want.items():
        assert got[k] == (n, least, rows[k][0] == least), (k, got[k], want[k])


def at_cosine(rng, u, c):
    z = rng.normal(size=len(u))
    z -= (z @ u) / (u @ u) * u
    return c * u / np.linalg.norm(u) + math.sqrt(1 - c * c) * z / np.linalg.norm(z)


def test_vector_links_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    rows = [(100 + k, list(map(float, base[k])), k % 3) for k in range(12)]
    rows += [(k, list(map(float, at_cosine(rng, base[k], 0.97) * 50)), k % 3) for k in range(6)]
    rows += [(3, rows[0][1], 0), (3, rows[0][1], 0), (None, rows[1][1], 1), (None, list(map(float, rng.normal(size=8))), 1)]
    rows += [(50, None, 1), (51, [], 1), (52, [0.0] * 8, 1), (53, [1.0, None] + [0.0] * 6, 1), (54, [float("nan")] * 8, 1), (55, [float("inf")] * 8, 1)]
    rows += [(56, rows[0][1], None), (57, rows[0][1], None), (58, rows[0][1][:5], 0), (59, rows[0][1][:5], 0), (60, [1e-200] * 8, 2), (61, [3e200] * 8, 2)]
    check_links(spark, rows)
    check_links(spark, [])


def test_vector_links_of_large_loose_components(spark):
    """A tight group, a chain of drifting vectors that is no ball, and a pair, all of one label."""
    rng = np.random.default_rng(2)
    centre, rows = rng.normal(size=24), []
    for k in range(420):
        rows.append((1000 + k, list(map(float, at_cosine(rng, centre, 0.9 + 0.1 * rng.random()))), 1))
    a, b = rng.normal(size=24), rng.normal(size=24)
    for k in range(400):
        t = k / 120
        rows.append((5000 - k, list(map(float, math.cos(t) * a + math.sin(t) * b + 0.02 * rng.normal(size=24))), 1))
    rows += [(7, rows[0][1], 1)] * 300
    check_links(spark, rows)


def test_lone_pairs_near_the_threshold_are_found(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(1500):
        u = rng.normal(size=64)
        rows += [(2 * k, list(map(float, u)), 1), (2 * k + 1, list(map(float, at_cosine(rng, u, 0.932))), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in sortedpasses.link_vectors(table, window=16).select("vec_id", "links.*").collect()}
    found = sum(got[2 * k + 1].component_id == 2 * k for k in range(1500)) / 1500
    assert found >= 1 - sortedpasses.MISS - 0.01
    assert all(r.n_links <= 1 for r in got.values())


def test_vector_links_keep_other_columns(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0], "x", 5, "t"), ("a", [2.0, 0.0], "x", 6, None)], "key string, v array<double>, l string, links int, label string")
    out = sortedpasses.link_vectors(df, "key", "v", "l")
    assert out.columns == ["key", "v", "l", "label", "links"]
    assert {(r.key, r.label, r.links.n_links, r.links.component_id, r.links.kept) for r in out.collect()} == {("a", None, 1, "a", True), ("b", "t", 1, "a", False)}


def test_passes_grow_with_the_label():
    small, large = sortedpasses.passes_for(10**4, 64), sortedpasses.passes_for(10**9, 64)
    assert 1 <= small < large < 60
    assert sortedpasses.passes_for(100, 64) == 1


def brute_clusters(rows, k=8, rounds=10, scale=1024, dim=64):
    """Row number -> (cluster, distance), and the centroids, in Python integers."""
    ints = {n: [math.floor(scale * float(x)) for x in v] for n, (_, v) in enumerate(rows) if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)}
    order = sorted(ints, key=lambda n: (rows[n][0] is None, hashlib.sha256(f"3:{rows[n][0]}".encode()).hexdigest(), rows[n][1]))
    cents = [list(ints[n]) for n in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for x in ints.values():
            groups[near(x)[1]].append(x)
        for j, own in groups.items():
            cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return {n: near(x)[::-1] for n, x in ints.items()}, cents


@pytest.mark.parametrize("shape", ["plain", "wide", "copies", "few", "one"])
def test_clusters_equal_python_integers(spark, shape):
    rng = np.random.default_rng(4)
    n = {"few": 5, "one": 1}.get(shape, 220)
    points = rng.normal(size=(n, 4)) * 0.3 + rng.integers(-2, 3, size=(n, 1)) * 0.3
    if shape == "wide":  # integers beyond four bytes
        points[7], points[8] = [6e5, -7e5, 1.0, 0.0], [6e5, 7e5, 2.5, 0.0]
    if shape == "copies":
        points[20:] = points[3]
    rows = [(int(i), list(map(float, v))) for i, v in zip(rng.permutation(n), points, strict=True)]
    rows += [(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4)]
    if shape == "plain":
        rows += [(None, rows[0][1]), (rows[1][0], rows[1][1]), (rows[2][0], rows[5][1])]
    table = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, cluster int")
    got = {r.cluster: r.clustering for r in centroids.cluster_vectors(table, dim=4, lead=2).collect()}
    want, cents = brute_clusters(rows, dim=4)
    assert {k: (r.cluster, r.distance) for k, r in got.items()} == want
    total = sum(d for _, d in want.values())
    for k, r in got.items():
        assert r.inertia == total and r.cluster_inertia == sum(d for c, d in want.values() if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def test_clusters_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, None, "a")], "vec_id long, embedding array<double>, note string")
    out = centroids.cluster_vectors(df)
    assert out.columns == ["vec_id", "embedding", "note", "clustering"] and out.collect() == []


def test_bounds_are_never_above_the_distance():
    rng = np.random.default_rng(5)
    for scale in (3, 300, 10**6):
        x, c = rng.integers(-scale, scale, size=(200, 10)), rng.integers(-scale, scale, size=(6, 10))
        axes = centroids.Filter(x.mean(axis=0), np.linalg.qr(rng.normal(size=(10, 3)))[0])
        lead, rest = axes.place(x)
        true = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        bound = axes.bounds(lead, rest, c)
        assert (bound <= true).all()
        best, far, compared = centroids.nearest(x, lead, rest, c, axes)
        assert (best == true.argmin(axis=1)).all() and (far == true.min(axis=1)).all()
        assert scale < 300 or compared < x.shape[0] * len(c)


def test_trie_finds_equal_texts():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) * rng.choice([1, 1, 400]) for _ in range(600)]
    trie, slots = Trie(), {}
    for i, t in enumerate(texts):
        assert slots.setdefault(t, trie.insert(t, 1000 - i)) == trie.insert(t, 1000 - i)
    assert [t for t, _ in trie.traverse()] == sorted(set(texts))
    assert all(trie.least[s] == min(1000 - i for i, x in enumerate(texts) if x == t) for t, s in slots.items())


def test_masks_equal_their_definition():
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "　", "𝕏", " ", "\t", "\x0b", "\x1c", "\x85", "#", "|", "word", "\n"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet[: rng.randrange(2, 15)]) for _ in range(rng.randrange(0, 400)))
        words = WORDS.findall(text)
        want = (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) << 2 | any(c in "#$%&*|" for c in text) << 3
        assert text_mask(text.encode()) == want


def brute_audit(docs, labels):
    """Rows of the audit by document loops."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    masks = collections.defaultdict(list)
    for i, t, p in docs:
        text = t or ""
        masks[p or ""].append((i, text_mask(text.encode()) | (16 if i is not None and i > least[text] else 0)))
    out = {}
    for part, rows in masks.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                lost = [i for i, m in rows if m & bit and not m & before]
                total[letter] += len(lost)
                out[part, "".join(order), step] = (
                    sum(not m & (bit | before) for _, m in rows), len(lost), sum(bool(m & bit and m & before) for _, m in rows),
                    sum(m == bit for _, m in rows), sum(i in good for i in lost), sum(i in toxic for i in lost))
                before |= bit
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                out[part, "".join(order), step] += (total[letter],)
    return out


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(texttries, "TRIE_BYTES", 30_000)  # seen by the driver only; the workers use their own
    header = "licence line of many documents " * 60
    docs = []
    for i in range(500):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([20, 110, 130]))]
        docs.append((i, (header if i % 3 == 0 else "") + " ".join(words) + rng.choice(["", " A|B", " " + "X" * 90]), rng.choice(["en", "de", None, ""])))
    for i in range(500, 800):  # a third of the rows are one text
        docs.append((i, docs[7][1], rng.choice(["en", "de"])))
    docs += [(800 + k, docs[k][1], "en") for k in range(0, 60, 7)] + [(7, docs[7][1], "en"), (7, docs[7][1], "fr"), (900, None, "en"), (901, "", "en"), (902, None, None)]
    docs += [(None, docs[7][1], "en"), (None, None, None), (950, "x " * 200_000, "en"), (951, "x " * 200_000, "en")]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 960, 2)] + [(4, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("n", F.lit("y")).repartition(7)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in texttries.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == brute_audit(docs, labels)


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert texttries.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_cuts_reach_into_shared_prefixes(spark):
    rng = random.Random(9)
    texts = ["common " * 40 + str(rng.random()) for _ in range(900)] + [str(rng.random()) for _ in range(100)]
    cuts = adaptive_cuts(spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("binary").alias("text")), 20)
    assert cuts == sorted(set(cuts)) and len(cuts) >= 12
    sizes = collections.Counter(sum(c <= t.encode() for c in cuts) for t in texts)
    assert max(sizes.values()) < 300
    copies = spark.createDataFrame([("same " * 30,)] * 500, "t string").select(F.col("t").cast("binary").alias("text"))
    assert adaptive_cuts(copies, 20) == []
