"""Full binning of a flow table (B9): IP, port, boolean, nominal and numeric bins.

``BinningModel.fit`` reads its input twice, whatever the number of columns and groups: once for
the column state (value counts and bucket counts, :mod:`flowbin.operators.state`), once for the
values near the trim's ranks.  Groups are taken from the state, so a group without any value of
a column is binned too.  What is fitted stays in tables in the shared folder: entries of the
frequency bins, and one row of parameters a group; the driver holds nothing that grows with
groups or values.  ``transform`` reads its input once: a join with the groups' parameters (when
grouped), one lookup join per frequency column, and one projection.
"""

from __future__ import annotations

import dataclasses
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbin.functions.classes import ip_class_of, ip_first_field, port_class_of, port_number
from flowbin.operators.frequency import BROADCAST_BYTES, FrequencyFit, Slot, fit_frequency, frequency_bin
from flowbin.operators.numeric import BROADCAST_GROUPS, NumericSpec, edge_arrays, numeric_bin, numeric_specs, stats_from_state
from flowbin.operators.state import column_state
from flowbin.session import remove_path, store
from flowbin.sources.schema import (
    BOOL_COLS, IP_COLS, NOMINAL_COLS, NUMERIC_COLS, PORT_COLS,
)

BIN_SUFFIX = "_bin"
#: Name of an extra coverage rank's slot, beside the slot of the column's bin.
EXTRA = "x:"


@dataclass
class BinningConfig:
    ip: list[str] = field(default_factory=lambda: list(IP_COLS))
    port: list[str] = field(default_factory=lambda: list(PORT_COLS))
    boolean: list[str] = field(default_factory=lambda: list(BOOL_COLS))
    nominal: list[str] = field(default_factory=lambda: list(NOMINAL_COLS))
    numeric: list[str] = field(default_factory=lambda: list(NUMERIC_COLS))
    #: "index" = frequency index (the shipped behaviour); "coverage" = top-coverage rank
    nominal_mode: str = "index"
    nominal_coverage: float = 0.98
    numeric_trim: float = 0.02
    #: extra top-coverage ranks fitted from the same counts but not features,
    #: ``{column: coverage}`` (the multi-class label is ``{"label_multi": 1.0}``)
    extra_coverage: dict[str, float] = field(default_factory=dict)

    def binned_columns(self) -> list[str]:
        return self.ip + self.port + self.boolean + self.nominal + self.numeric

    def slots(self) -> list[Slot]:
        """The frequency bins to fit."""
        cover = self.nominal_coverage if self.nominal_mode == "coverage" else None
        return [*[Slot(c, c) for c in self.boolean], *[Slot(c, c, cover) for c in self.nominal], *[Slot(EXTRA + c, c, pct) for c, pct in self.extra_coverage.items()]]


@dataclass
class BinningModel:
    config: BinningConfig
    by: list[str]
    by_types: list[T.DataType]
    n_groups: int
    frequency: FrequencyFit | None
    stats: DataFrame | None = field(repr=False)   # (by..., cname, n_rows, n_kept, mean, sd, minimum)
    params: DataFrame | None = field(repr=False)  # one row a group
    state: DataFrame | None = field(default=None, repr=False)  # the column state of the fitted rows
    paths: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, config: BinningConfig | None = None, by: list[str] | None = None,
            groups_of: DataFrame | None = None) -> "BinningModel":
        """Fit on ``df``; ``groups_of`` (default ``df``) is the table whose groups get bins."""
        config = config or BinningConfig()
        by = list(by or [])
        slots = config.slots()
        columns = sorted({s.column for s in slots})
        types = [df.schema[b].dataType for b in by]
        if not columns and not config.numeric:
            return cls(config, by, types, 0, None, None, None)
        counted = column_state(df, columns, config.numeric, by)
        if groups_of is not None and groups_of is not df:
            empty = column_state(groups_of.select(*by).distinct().select(*by, *[F.lit(None).cast("string").alias(c) for c in columns + config.numeric if c not in by]), columns, config.numeric, by)
            counted = counted.unionByName(empty.withColumn("k", F.lit(0).cast("long")))
        state, state_path = store(counted, "state")
        n_groups = state.select(*by).distinct().count() if by else 1
        # two chains of small jobs: submitted from two threads, so that they overlap
        with ThreadPoolExecutor(max_workers=2) as pool:
            freq = pool.submit(fit_frequency, state, slots, by) if slots else None
            stat = pool.submit(stats_from_state, df, state, config.numeric, config.numeric_trim, by, n_groups) if config.numeric else None
            frequency = freq.result() if freq else None
            stats, stats_path = stat.result() if stat else (None, None)
        model = cls(config, by, types, n_groups, frequency, stats, None, state, [p for p in (state_path, stats_path) if p])
        model.params, path = store(model._parameter_table(), "params")
        model.paths.append(path)
        return model

    def _names(self) -> tuple[list[str], list[str]]:
        return [s.name for s in self.config.slots()], list(dict.fromkeys(self.config.numeric))

    def _parameter_table(self) -> DataFrame:
        """One row a group: null and other bin of each slot, edges of each numeric column."""
        slots, numeric = self._names()
        groups = [F.col(b).alias(f"_fb_g{i}") for i, b in enumerate(self.by)]
        none = {"slot": "string", "null_bin": "int", "other_bin": "int", "cname": "string", "edges": "array<double>"}
        parts = []
        if self.frequency is not None:
            parts.append(self.frequency.bins.select(*groups, "slot", "null_bin", "other_bin", *[F.lit(None).cast(none[c]).alias(c) for c in ("cname", "edges")]))
        if self.stats is not None:
            parts.append(edge_arrays(self.stats).select(*groups, *[F.lit(None).cast(none[c]).alias(c) for c in ("slot", "null_bin", "other_bin")], "cname", "edges"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        aggs = [F.max(F.when(F.col("slot") == s, F.col(f"{kind}_bin"))).alias(f"_fb_f{i}_{kind[0]}") for i, s in enumerate(slots) for kind in ("null", "other")]
        aggs += [F.max(F.when(F.col("cname") == c, F.col("edges"))).alias(f"_fb_e{i}") for i, c in enumerate(numeric)]
        return rows.groupBy(*[f"_fb_g{i}" for i in range(len(self.by))]).agg(*aggs)

    def group_rows(self) -> DataFrame:
        """(by..., n): the fitted rows of each group, from the state."""
        slots = self.config.slots()
        column, kind = (slots[0].column, "b") if slots else (self.config.numeric[0], "v")
        own = self.state.where((F.col("cname") == column) & F.col(kind).isNull())
        return own.groupBy(*self.by).agg(F.sum("k").alias("n"))

    @property
    def numeric(self) -> dict[tuple, NumericSpec]:
        """What was fitted of the numeric columns, on the driver: for fits of few groups."""
        return {} if self.stats is None else numeric_specs(self.stats, self.by)

    def release(self) -> None:
        """Delete the fitted tables; the model cannot transform afterwards."""
        spark = next((t.sparkSession for t in (self.params, self.stats) if t is not None), None)
        for path in [*self.paths, *(self.frequency.paths if self.frequency else [])]:
            remove_path(spark, path)

    def save(self, path: str) -> None:
        """Write the fitted model to a folder that is not there yet; :meth:`load` reads it back."""
        tables = {"params": self.params, "stats": self.stats}
        if self.frequency is not None:
            tables |= {"entries": self.frequency.entries, "bins": self.frequency.bins}
        tables = {n: t for n, t in tables.items() if t is not None}
        for name, table in tables.items():
            table.write.parquet(f"{path}/{name}")
        spark = next((t.sparkSession for t in tables.values()), None) or SparkSession.active()
        about = {"config": dataclasses.asdict(self.config), "by": self.by, "by_types": [t.jsonValue() for t in self.by_types], "n_groups": self.n_groups,
                 "tables": sorted(tables), "sizes": [] if self.frequency is None else [[s, c, n, b] for s, x in self.frequency.sizes.items() for c, (n, b) in x.items()]}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BinningModel":
        """A saved model; its tables stay where they are, and :meth:`release` leaves them."""
        about = json.loads(spark.read.text(f"{path}/model").first()["value"])
        table = {n: spark.read.parquet(f"{path}/{n}") for n in about["tables"]}
        frequency = None
        if "entries" in table:
            sizes: dict[str, dict[int, tuple[int, int]]] = {}
            for s, c, n, b in about["sizes"]:
                sizes.setdefault(s, {})[c] = (n, b)
            frequency = FrequencyFit(about["by"], table["bins"], table["entries"], sizes)
        types = [T._parse_datatype_json_value(t) for t in about["by_types"]]
        return cls(BinningConfig(**about["config"]), about["by"], types, about["n_groups"], frequency, table.get("stats"), table.get("params"))

    def _parameters(self, df: DataFrame) -> tuple[DataFrame, dict[str, tuple[Column, Column]], dict[str, tuple[list[Column], Column]]]:
        """The frame, null and other bin of each slot, and edges of each numeric column.

        Without groups these are literals; with groups, columns of the joined table.
        """
        slots, numeric = self._names()
        if self.params is None:
            return df, {}, {}
        if not self.by:
            row = self.params.first()  # one row
            # a table without rows has fitted nulls
            bins = {s: (F.lit(row[f"_fb_f{i}_n"] or 0), F.lit(row[f"_fb_f{i}_o"] or 0)) for i, s in enumerate(slots)}
            found = {c: list(row[f"_fb_e{i}"] or []) for i, c in enumerate(numeric)}
            return df, bins, {c: ([F.lit(x) for x in e], F.lit(len(e))) for c, e in found.items()}
        table = F.broadcast(self.params) if self.n_groups <= BROADCAST_GROUPS else self.params
        same = F.lit(True)
        for i, b in enumerate(self.by):
            same = same & df[b].eqNullSafe(table[f"_fb_g{i}"])
        both = df.join(table, same, "left")
        bins = {s: (F.col(f"_fb_f{i}_n"), F.col(f"_fb_f{i}_o")) for i, s in enumerate(slots)}
        edges = {c: ([F.get(F.col(f"_fb_e{i}"), F.lit(k)) for k in range(5)], F.size(f"_fb_e{i}")) for i, c in enumerate(numeric)}
        return both, bins, edges

    def transform(self, df: DataFrame, replace: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Add ``<col>_bin`` int columns (or replace the sources when ``replace``).

        A row of a group that was not there at fit gets null bins.
        """
        cfg = self.config
        out, bins, edges = self._parameters(df)
        text = {c: F.col(c).cast("string") for c in cfg.boolean + cfg.nominal}
        for c in cfg.boolean + cfg.nominal:
            out = self.frequency.lookup(out, c, text[c], f"_fb_b_{c}", broadcast_bytes)
        for c in cfg.extra_coverage:
            out = self.frequency.lookup(out, EXTRA + c, F.col(c).cast("string"), f"_fb_x_{c}", broadcast_bytes)
        # sources are parsed once, then mapped
        helpers = {f"_fb_h_{c}": ip_first_field(c) for c in cfg.ip} | {f"_fb_h_{c}": port_number(c) for c in cfg.port}
        helpers |= {f"_fb_h_{c}": F.col(c).cast("double") for c in cfg.numeric}
        out = out.select("*", *[e.alias(n) for n, e in helpers.items()])
        h = lambda c: F.col(f"_fb_h_{c}")

        exprs: dict[str, Column] = {c: ip_class_of(h(c)) for c in cfg.ip} | {c: port_class_of(h(c)) for c in cfg.port}
        for c in cfg.boolean + cfg.nominal:
            exprs[c] = frequency_bin(text[c], F.col(f"_fb_b_{c}"), *bins[c])
        for c in cfg.numeric:
            exprs[c] = numeric_bin(h(c), *edges[c])
            if self.by:
                exprs[c] = F.when(edges[c][1] >= 0, exprs[c])
        extra = {c + BIN_SUFFIX: frequency_bin(F.col(c).cast("string"), F.col(f"_fb_x_{c}"), *bins[EXTRA + c]) for c in cfg.extra_coverage}

        ordered = cfg.binned_columns()
        if replace:
            keep_cols = [F.col(c) for c in df.columns if c not in set(ordered)]
            return out.select(*keep_cols, *[exprs[c].alias(c) for c in ordered], *[e.alias(n) for n, e in extra.items()])
        # frequency-indexed sources are left cast to string, as the indexer input
        cast = {c: text[c] for c in cfg.boolean + (cfg.nominal if cfg.nominal_mode == "index" else [])}
        base = [cast.get(c, F.col(c)).alias(c) for c in df.columns]
        return out.select(*base, *[exprs[c].alias(c + BIN_SUFFIX) for c in ordered], *[e.alias(n) for n, e in extra.items()])

    def feature_names(self) -> list[str]:
        return [c + BIN_SUFFIX for c in self.config.binned_columns()]
