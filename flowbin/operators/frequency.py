"""Frequency-based bins: frequency index (B8) and top-coverage rank (B7).

The fit reads the value counts of :mod:`flowbin.operators.state`, in which a value that holds
a third of all rows costs one row per map task before the shuffle.  Ranks come from
:mod:`flowbin.operators.ranking`.

The fitted bins are two tables: entries keyed by (group, slot, value), and the bins of null
and of other values keyed by (group, slot).  Neither goes through the driver.  A slot is a
fitted column; a column may have more than one.  A column is binned by one join with its part
of the entries, whatever the number of groups or values: broadcast where the part's counted
bytes allow it, else the entries from a count on are broadcast and the rows that they miss
meet the whole part in a shuffle join, in the same pass.  That count comes from the fit, which
keeps the bytes of each slot by the size of the count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbin.operators.ranking import rank_and_cumsum
from flowbin.operators.state import column_state, same_keys
from flowbin.session import store

#: Most bytes of one column's entries, over all groups, that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of an entry beside its value and group.
ENTRY_BYTES = 48
#: Keys over which rows that need no further lookup are spread.
SPREAD = 1024
#: Size classes of the counts to each doubling.
COUNT_CLASSES = 4

# Fixed value: the coverage bin keeps at least this many top values
# (fewer only when the column has fewer distinct values).
COVERAGE_MIN_TOP = 5


@dataclass(frozen=True)
class Slot:
    """A frequency bin to fit: by index, or by rank up to a coverage."""

    name: str
    column: str
    coverage: float | None = None


@dataclass
class FrequencyFit:
    by: list[str]
    bins: DataFrame = field(repr=False)     # (by..., slot, null_bin, other_bin)
    entries: DataFrame = field(repr=False)  # (by..., slot, v, k, b)
    #: of each slot, entries and bytes by the class of their count
    sizes: dict[str, dict[int, tuple[int, int]]] = field(default_factory=dict)
    paths: list[str] = field(default_factory=list)

    def lookup(self, df: DataFrame, slot: str, value: Column, out: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Add ``out``: the bin of ``value`` where it has an entry, else null."""
        return lookup_join(df, self.entries.where(F.col("slot") == slot), value, out, self.by, self.head(slot, broadcast_bytes))

    def head(self, slot: str, broadcast_bytes: int) -> int | None:
        """Least count of the entries to broadcast; None for all."""
        sizes = self.sizes.get(slot, {})
        if sum(n_bytes for _, n_bytes in sizes.values()) <= broadcast_bytes:
            return None
        least, held = max(sizes) + 1, 0
        for c in sorted(sizes, reverse=True):
            held += sizes[c][1]
            if held > broadcast_bytes:
                break
            least = c
        return count_of_class(least)


def class_of_count(k: Column) -> Column:
    return F.floor(F.log2(k.cast("double")) * COUNT_CLASSES + 1e-9).cast("int")


def count_of_class(c: int) -> int:
    """The least count of a size class."""
    k = max(1, int(2 ** (c / COUNT_CLASSES)) - 1)
    while 2 ** (c / COUNT_CLASSES) > k * (1 + 1e-9):
        k += 1
    return k


def value_counts(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., cname, v, k): count of each non-null value (as string) per column."""
    return column_state(df, cols, [], by).where("v IS NOT NULL").drop("b")


def fit_frequency(state: DataFrame, slots: list[Slot], by: list[str] | None = None) -> FrequencyFit:
    """Fit all slots and groups from a stored :func:`column_state`, in the same few jobs."""
    by = list(by or [])
    keys = by + ["cname"]
    columns = sorted({s.column for s in slots})
    mine = state.where(F.col("cname").isin(columns))
    temps: list[DataFrame] = []
    ranked = rank_and_cumsum(mine.where("v IS NOT NULL").select(*keys, "v", "k"), keys, [F.col("k").desc(), F.col("v").asc()], sum_col="k", kept=temps)
    stat = mine.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("k"))), F.lit(0)).alias("tot"), F.count("v").alias("u"))
    other = stat.select(*[F.col(c).alias("_" + c) for c in keys], "tot", "u")
    placed = ranked.join(other, same_keys(ranked, other, keys, "_")).drop(*["_" + c for c in keys])

    entries, bins = [], []
    plain = [s for s in slots if s.coverage is None]
    if plain:
        names = {s.column: s.name for s in plain}
        entries.append(_named(placed, names).select(*by, "slot", "v", "k", (F.col("rank") - 1).alias("b")))
        bins.append(_named(stat, names).select(*by, "slot", F.col("u").alias("null_bin"), F.col("u").alias("other_bin")))
    for pct in sorted({s.coverage for s in slots if s.coverage is not None}):
        names = {s.column: s.name for s in slots if s.coverage == pct}
        reached = _named(placed, names).where(F.col("cum") >= F.col("tot") * F.lit(float(pct))).groupBy(*by, "slot").agg(F.min("rank").alias("i"))
        reached = reached.select(*[F.col(c).alias("_" + c) for c in [*by, "slot"]], "i")
        all_ = _named(stat, names)
        top = F.greatest(F.coalesce("i", F.lit(1)), F.least(F.lit(COVERAGE_MIN_TOP), F.col("u")))
        limit = all_.join(reached, same_keys(all_, reached, [*by, "slot"], "_"), "left").select(*by, "slot", top.cast("long").alias("j"))
        bins.append(limit.select(*by, "slot", F.lit(0).cast("long").alias("null_bin"), (F.col("j") + 1).alias("other_bin")))
        last = limit.select(*[F.col(c).alias("_" + c) for c in [*by, "slot"]], "j")
        found = _named(placed, names)
        entries.append(found.join(last, same_keys(found, last, [*by, "slot"], "_")).where("rank <= j").select(*by, "slot", "v", "k", F.col("rank").alias("b")))
    whole, path = store(_union(entries).select(*by, "slot", "v", "k", F.col("b").cast("int").alias("b")), "entries")
    all_bins, bins_path = store(_union(bins).select(*by, "slot", F.col("null_bin").cast("int").alias("null_bin"), F.col("other_bin").cast("int").alias("other_bin")), "bins")
    for t in temps:
        t.unpersist()
    return FrequencyFit(by, all_bins, whole, entry_sizes(whole, by), [path, bins_path])


def entry_sizes(entries: DataFrame, by: list[str]) -> dict[str, dict[int, tuple[int, int]]]:
    """Entries and bytes of each slot by the size class of their count: at most some 250 rows a slot."""
    width = F.octet_length("v") + F.lit(ENTRY_BYTES)
    for c in by:
        width = width + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    out: dict[str, dict[int, tuple[int, int]]] = {}
    rows = entries.groupBy("slot", class_of_count(F.col("k")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes"))
    for r in rows.collect():
        out.setdefault(r["slot"], {})[r["c"]] = (int(r["n"]), int(r["bytes"]))
    return out


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The rows of some columns, with the slot of each."""
    slot = F.lit(None).cast("string")
    for column, name in names.items():
        slot = F.when(F.col("cname") == column, F.lit(name)).otherwise(slot)
    return df.where(F.col("cname").isin(list(names))).withColumn("slot", slot)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def lookup_join(df: DataFrame, entries: DataFrame, value: Column, out: str, by: list[str], least: int | None = None) -> DataFrame:
    """Add ``out``: the bin ``b`` of ``value`` in ``entries`` (by..., v, k, b), null if absent.

    Without ``least`` all entries are broadcast.  Else those with a count from ``least`` on are;
    rows that they answer, and rows without a value, are spread evenly in the shuffle join that
    serves the others.
    """
    keyed = df.withColumn("_fb_v", value)

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"_{name}_{c}") for c in by], F.col("v").alias(f"_{name}_v"), F.col("b").alias(f"_{name}_b"))

    def on(left: DataFrame, right: DataFrame, name: str, key: Column) -> Column:
        return (key == right[f"_{name}_v"]) & same_keys(left, right, by, f"_{name}_")

    head = F.broadcast(side(entries if least is None else entries.where(F.col("k") >= least), "h"))
    step = keyed.join(head, on(keyed, head, "h", keyed["_fb_v"]), "left")
    if least is None:
        return step.select(*df.columns, F.col("_h_b").alias(out))
    step = step.select(*df.columns, "_fb_v", "_h_b")
    open_ = F.col("_h_b").isNull() & F.col("_fb_v").isNotNull()
    step = step.withColumn("_fb_o", F.when(open_, F.col("_fb_v"))).withColumn(
        "_fb_s", F.when(open_, F.lit(0)).otherwise(1 + F.monotonically_increasing_id() % SPREAD).cast("int"))
    table = side(entries.where(F.col("k") < least), "t").withColumn("_t_s", F.lit(0))
    step = step.join(table, on(step, table, "t", step["_fb_o"]) & (step["_fb_s"] == table["_t_s"]), "left")
    return step.select(*df.columns, F.coalesce("_h_b", "_t_b").alias(out))


def frequency_bin(value: Column, found: Column, null_bin: Column, other_bin: Column) -> Column:
    """The bin of a value given its entry's bin (null: no entry)."""
    return F.when(value.isNull(), null_bin).otherwise(F.coalesce(found, other_bin)).cast("int")
