"""Randomised checks against brute-force Python statements of each rule."""

import math
import random
import re
import statistics

import pytest

from flowbin.functions.classes import ip_class, port_class
from flowbin.operators.numeric import trim_stats

_INT = re.compile(r"\s*[+-]?\d+\s*")


def _as_int(text):
    if text is None or not _INT.fullmatch(text):
        return None
    n = int(text)
    return n if -2**63 <= n < 2**63 else None


def _classify(n, uppers):
    if 0 <= n <= uppers[0]:
        return 1
    for k, u in enumerate(uppers[1:], start=2):
        if n <= u:
            return k
    return len(uppers) + 1


def ip_model(s):
    if s is None or "." not in s:
        return 0
    n = _as_int(s.split(".")[0])
    return 0 if n is None else _classify(n, [127, 191, 223, 239, 254])


def port_model(s):
    n = _as_int(s)
    return 0 if n is None else _classify(n, [1023, 49151, 65535])


def test_ip_and_port_classes_match_rule(spark):
    rnd = random.Random(7)
    alphabet = "0123456789....::-+ abcf"
    vals = [None, ""] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    vals += [f"{rnd.randint(-300, 400)}.{rnd.randint(0, 255)}.0.1" for _ in range(1000)]
    vals += [str(rnd.randint(-100, 80000)) for _ in range(1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    got = df.select("i", ip_class("s").alias("ip"), port_class("s").alias("port")).orderBy("i").collect()
    for r in got:
        v = vals[r["i"]]
        assert r["ip"] == ip_model(v), v
        assert r["port"] == port_model(v), v


def trim_model(values, pct):
    xs = sorted(v for v in values if v is not None and not math.isnan(v))
    n = len(xs)
    o = math.floor(n * pct)
    kept = [x for rank, x in enumerate(xs, start=1) if rank >= o and rank <= n - o]
    sd = statistics.stdev(kept) if len(kept) > 1 else 0.0
    return n, len(kept), statistics.fmean(kept), sd, kept[0]


@pytest.mark.parametrize("accuracy", [10_000, 10])
def test_trim_matches_sorted_list(spark, accuracy):
    rnd = random.Random(11 + accuracy)
    cols = {}
    for c in range(6):
        n = rnd.randint(40, 400)
        pool = [round(rnd.uniform(-50, 500), rnd.choice([0, 1, 3])) for _ in range(rnd.randint(3, 60))]
        vals = [rnd.choice(pool) for _ in range(n)]
        vals += [None] * rnd.randint(0, 5) + [float("nan")] * rnd.randint(0, 3)
        cols[f"c{c}"] = vals
    rows = []
    width = max(len(v) for v in cols.values())
    for i in range(width):
        rows.append(tuple(cols[c][i] if i < len(cols[c]) else None for c in cols))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    for pct in (0.02, 0.1):
        got = {r["cname"]: r for r in trim_stats(df, list(cols), pct, accuracy=accuracy).collect()}
        for c, vals in cols.items():
            n, nk, m, sd, mn = trim_model(vals, pct)
            r = got[c]
            assert (r["n_rows"], r["n_kept"], r["minimum"]) == (n, nk, mn), c
            assert r["mean"] == pytest.approx(m, rel=1e-12, abs=1e-9)
            assert r["sd"] == pytest.approx(sd, rel=1e-9, abs=1e-9)
