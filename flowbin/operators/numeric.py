"""Standard-deviation bins with an exact two-sided trim (B1-B4).

The trim keeps the rows ranked ``max(o, 1) .. n - o`` of each column sorted ascending,
``o = floor(n * trim)`` (non-null, non-NaN values only).  The fit never shuffles the data:

1. The bucket counts of :mod:`flowbin.operators.state` tell, for each group and column, in which
   buckets the two boundary ranks lie and how many rows come before, exactly.
2. One pass over the rows sums the values between the two buckets and counts the values inside
   them (between the least and the greatest value that the state saw there), about a thousandth of the rows; only these are shuffled and ranked.  A value's kept
   copies follow from its rank, so the trimmed count, sums and minimum are exact.

Sums are taken round a value near the median, which avoids the cancellation of
``E[x^2] - m^2``.  Everything fitted stays a table keyed by (group, column).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbin.operators.ranking import rank_and_cumsum
from flowbin.operators.state import ACCURACY, column_state, same_keys
from flowbin.session import remove_path, store

#: Most groups whose parameters are broadcast; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 10_000


@dataclass
class NumericSpec:
    """What was fitted for one column of one group; for looking at small fits."""

    column: str
    group: tuple
    edges: list[float] = field(default_factory=list)  # distinct interior edges, ascending
    n_rows: int = 0       # non-null, non-NaN rows seen
    n_kept: int = 0       # rows kept by the trim
    mean: float | None = None
    sd: float | None = None
    minimum: float | None = None


def brackets(state: DataFrame, cols: list[str], trim: float, by: list[str]) -> DataFrame:
    """Per (by..., cname): rows, both ranks, the ends of their buckets, the rows before these, and a centre."""
    keys = by + ["cname"]
    mine = state.where(F.col("cname").isin(cols) & F.col("v").isNull()).select(*keys, "b", "k", "mn", "mx")
    # buckets of one column of one group: some thousands
    whole = Window.partitionBy(*keys)
    counted = F.when(F.col("b").isNotNull(), F.col("k")).otherwise(0)
    run = mine.withColumn("n", F.sum(counted).over(whole)).withColumn(
        "cum", F.sum(counted).over(whole.orderBy(F.col("b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    out = F.floor(F.col("n") * F.lit(float(trim)))
    run = run.withColumn("lo", F.greatest(out, F.lit(1))).withColumn("hi", F.col("n") - out)
    real = F.col("b").isNotNull()
    # buckets do not overlap, so the first one that reaches a rank has the least ends of those that do
    start = lambda rank: F.min(F.when(real & (F.col("cum") >= rank), F.col("mn")))
    end = lambda rank: F.min(F.when(real & (F.col("cum") >= rank), F.col("mx")))
    before = lambda rank: F.coalesce(F.max(F.when(real & (F.col("cum") < rank), F.col("cum"))), F.lit(0))
    lo, hi = F.col("lo"), F.col("hi")
    finite = lambda x: F.when(F.abs(x) < float("inf"), x).otherwise(0.0)
    found = run.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), start(lo).alias("a1"), end(lo).alias("e1"), start(hi).alias("a2"), end(hi).alias("e2"),
        before(lo).alias("below1"), before(hi).alias("below2"), start(F.col("n") / 2).alias("c"))
    return found.withColumn("c", finite(F.coalesce("c", F.lit(0.0))))


_LIMITS = ("a1", "e1", "a2", "e2", "c")


def _zones(df: DataFrame, cols: list[str], by: list[str], found: DataFrame, n_groups: int) -> DataFrame:
    """(by..., cname, z, x, k, s, ss): values in the two buckets (z 1 and 3), sums between them (z 2)."""
    names = [f"_fb_z{i}" for i in range(len(cols))]
    part = lambda c: F.when(F.col("cname") == c, F.struct(*_LIMITS))
    table = found.where("hi >= lo").groupBy(*[F.col(c).alias(f"_fb_g{i}") for i, c in enumerate(by)]).agg(*[F.max(part(c)).alias(n) for c, n in zip(cols, names, strict=True)])
    if by:
        table = F.broadcast(table) if n_groups <= BROADCAST_GROUPS else table
        cond = F.lit(True)
        for i, c in enumerate(by):
            cond = cond & df[c].eqNullSafe(table[f"_fb_g{i}"])
        both = df.select(*by, *cols).join(table, cond)
        limits = {c: F.col(n) for c, n in zip(cols, names, strict=True)}
    else:
        both, row = df.select(*cols), table.first()  # one row
        kind = dict(zip(names, [f.dataType for f in table.schema.fields], strict=True))
        limits = {c: F.lit(None).cast(kind[n]) if row is None or row[n] is None else F.struct(*[F.lit(row[n][p]).cast("double").alias(p) for p in _LIMITS])
                  for c, n in zip(cols, names, strict=True)}
    items = F.array(*[F.struct(F.lit(c).alias("cname"), F.col(c).cast("double").alias("x"), limits[c].alias("l")) for c in cols])
    long = both.select(*by, F.inline(items))
    x = F.col("x")
    within = lambda a, e: (x >= F.col(f"l.{a}")) & (x <= F.col(f"l.{e}"))
    zone = F.when(within("a1", "e1"), 1).when(within("a2", "e2"), 3).when((x > F.col("l.e1")) & (x < F.col("l.a2")), 2)
    # rows outside stay in, without a zone: a filter would work the zone out twice
    inside = long.where(x.isNotNull()).withColumn("z", zone)
    dev = F.col("x") - F.col("l.c")
    mid = F.when(F.col("z") == 2, dev)
    return inside.groupBy(*by, "cname", "z", F.when(F.col("z") != 2, x).alias("x")).agg(
        F.count(F.lit(1)).alias("k"), F.sum(mid).alias("s"), F.sum(mid * mid).alias("ss")).where("z IS NOT NULL")


def stats_from_state(df: DataFrame, state: DataFrame, cols: list[str], trim: float, by: list[str], n_groups: int = 1) -> tuple[DataFrame, str]:
    """(by..., cname, n_rows, n_kept, mean, sd, minimum), stored, and its path.

    ``state`` is the stored column state of ``df``, which is read once more.  Columns and groups
    without any value are there, with n_rows 0.
    """
    keys = by + ["cname"]
    found, found_path = store(brackets(state, cols, trim, by), "brackets")
    hist, hist_path = store(_zones(df, cols, by, found, n_groups), "zones")
    temps: list[DataFrame] = []
    ranked = rank_and_cumsum(hist.where("z != 2").select(*keys, "z", "x", "k"), [*keys, "z"], [F.col("x").asc()], "k", kept=temps)
    side = found.select(*[F.col(c).alias("_" + c) for c in keys], "lo", "hi", "below1", "below2", "c")
    both = ranked.join(side, same_keys(ranked, side, keys, "_")).drop(*["_" + c for c in keys])
    before = F.when(F.col("z") == 1, F.col("below1")).otherwise(F.col("below2")) + F.col("cum") - F.col("k")
    w = F.greatest(F.lit(0), F.least(before + F.col("k"), F.col("hi")) - F.greatest(before, F.col("lo") - 1))
    dev = F.col("x") - F.col("c")
    ends = both.withColumn("w", w).where("w > 0").select(*keys, F.col("w").alias("n"), (F.col("w") * dev).alias("s"), (F.col("w") * dev * dev).alias("ss"), F.col("x").alias("mn"))
    middle = hist.where("z = 2").select(*keys, F.col("k").alias("n"), "s", "ss", F.lit(None).cast("double").alias("mn"))
    sums = ends.unionByName(middle).groupBy(*keys).agg(F.sum("n").alias("n_kept"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("mn").alias("minimum"))
    right = sums.select(*[F.col(c).alias("_" + c) for c in keys], "n_kept", "s", "ss", "minimum")
    all_ = found.join(right, same_keys(found, right, keys, "_"), "left")
    n = F.col("n_kept")
    spread = F.sqrt(F.greatest(F.col("ss") - F.col("s") * F.col("s") / n, F.lit(0.0)) / (n - 1))
    stats = all_.select(*keys, F.col("n").cast("long").alias("n_rows"), F.coalesce(n, F.lit(0)).cast("long").alias("n_kept"),
                        (F.col("c") + F.col("s") / n).alias("mean"), F.when(n > 1, spread).when(n == 1, 0.0).alias("sd"), "minimum")
    done, path = store(stats, "stats")
    for t in temps:
        t.unpersist()
    for p in (found_path, hist_path):
        remove_path(df.sparkSession, p)
    return done, path


def trim_stats(df: DataFrame, cols: list[str], trim: float = 0.02, by: list[str] | None = None,
               accuracy: int = ACCURACY) -> DataFrame:
    """(by..., cname, n_rows, n_kept, mean, sd, minimum) of the trimmed values.

    Columns without any non-null, non-NaN value have no row.
    """
    by = list(by or [])
    state, path = store(column_state(df, [], cols, by, accuracy), "state")
    n_groups = state.select(*by).distinct().count() if by else 1
    stats, _ = stats_from_state(df, state, cols, trim, by, n_groups)
    remove_path(df.sparkSession, path)
    return stats.where("n_rows > 0")


def _center(m: Column, s: Column, mn: Column) -> Column:
    """Centre moved up by whole standard deviations while m - 2s < 0, for a
    column without negative values (at most two steps: m >= min >= 0)."""
    m1 = m + s
    m2 = m1 + s
    shifted = F.when(m - s * 2 >= 0, m).when(m1 - s * 2 >= 0, m1).otherwise(m2)
    return F.when(mn >= 0, shifted).otherwise(m)


def edges_frame(stats: DataFrame) -> DataFrame:
    """Add the shifted centre and the five interior edges e1..e5 (with repeats)."""
    m, s, mn = F.col("mean"), F.coalesce(F.col("sd"), F.lit(0.0)), F.col("minimum")
    out = stats.withColumn("center", _center(m, s, mn))
    cc = F.col("center")
    return out.select(
        "*", (cc - s * 2).alias("e1"), (cc - s).alias("e2"), cc.alias("e3"),
        (cc + s).alias("e4"), (cc + s * 2).alias("e5"))


def edge_arrays(stats: DataFrame) -> DataFrame:
    """The statistics with ``edges``: the distinct interior edges, ascending; none without a mean."""
    e = F.array_distinct(F.array("e1", "e2", "e3", "e4", "e5"))
    out = edges_frame(stats)
    return out.select(*stats.columns, F.when(F.col("mean").isNotNull(), e).otherwise(F.array().cast("array<double>")).alias("edges"))


def numeric_specs(stats: DataFrame, by: list[str]) -> dict[tuple, NumericSpec]:
    """The statistics as records on the driver, for fits of few groups."""
    out = {}
    for r in edge_arrays(stats).collect():
        g = tuple(r[b] for b in by)
        out[(g, r["cname"])] = NumericSpec(r["cname"], g, list(r["edges"]), r["n_rows"], r["n_kept"], r["mean"], r["sd"], r["minimum"])
    return out


def fit_numeric(df: DataFrame, cols: list[str], trim: float = 0.02, by: list[str] | None = None,
                accuracy: int = ACCURACY) -> dict[tuple, NumericSpec]:
    """Fit trimmed mean / sd / min and edges; ``{(group, column): spec}``, for few groups.

    A column without values has no record.
    """
    return numeric_specs(trim_stats(df, cols, trim, by, accuracy), list(by or []))


def numeric_bin(value: Column, edges: list[Column], n_edges: Column) -> Column:
    """Bin of a double: null 0, NaN one past the last bucket, else 1 + the number
    of edges <= value.  Missing edges are null and count nothing."""
    above = F.lit(1)
    for e in edges:
        above = above + F.coalesce((value >= e).cast("int"), F.lit(0))
    return F.when(value.isNull(), 0).when(F.isnan(value), n_edges + 2).otherwise(above).cast("int")
