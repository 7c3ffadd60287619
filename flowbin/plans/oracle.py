"""DuckDB oracle SQL for the named queries.

Every text starts from the raw tables; the flow view comes from the ``conn``
fixture's select list and the rename map, nothing else is shared with the Spark
side.  The SQL states each rule directly (row numbers over the sorted column,
windows over the frequency table): the plain definition that the distributed
operators must reproduce.
"""

from __future__ import annotations

from flowbin.sources.fixtures import CONN_SQL, SCORED_SQL
from flowbin.sources.schema import RENAME_MAP

IP_COLS = ["dest_ip", "src_ip"]
PORT_COLS = ["dest_port", "src_port"]
BOOL_COLS = ["local_orig", "local_resp"]
NOMINAL_COLS = ["protocol", "conn_state", "history", "service"]
NUMERIC_COLS = ["duration", "orig_bytes", "orig_pkts", "orig_ip_bytes", "resp_bytes", "resp_pkts", "resp_ip_bytes", "missed_bytes"]
RANKED = ["history", "protocol", "service", "orig_bytes", "dest_ip", "orig_pkts", "orig_ip_bytes", "local_resp", "dest_port",
          "duration", "conn_state", "resp_pkts", "resp_ip_bytes", "src_port", "resp_bytes", "src_ip", "local_orig", "missed_bytes"]
COVERAGE_MIN_TOP = 5


def ip_class_sql(c: str) -> str:
    """Address class by the first octet: to 127, 191, 223, 239, 254, above."""
    head = f"TRY_CAST(split_part(CAST({c} AS VARCHAR), '.', 1) AS BIGINT)"
    return (f"CAST(CASE WHEN {c} IS NULL OR instr(CAST({c} AS VARCHAR), '.') = 0 OR {head} IS NULL THEN 0 "
            f"WHEN {head} BETWEEN 0 AND 127 THEN 1 WHEN {head} <= 191 THEN 2 WHEN {head} <= 223 THEN 3 "
            f"WHEN {head} <= 239 THEN 4 WHEN {head} <= 254 THEN 5 ELSE 6 END AS INT)")


def port_class_sql(c: str) -> str:
    """Port class: to 1023, 49151, 65535, above."""
    n = f"TRY_CAST({c} AS BIGINT)"
    return (f"CAST(CASE WHEN {n} IS NULL THEN 0 WHEN {n} BETWEEN 0 AND 1023 THEN 1 WHEN {n} <= 49151 THEN 2 "
            f"WHEN {n} <= 65535 THEN 3 ELSE 4 END AS INT)")


def binary_label_sql() -> str:
    return "CASE WHEN label_multi <> 'none' THEN 0.0e0 ELSE 1.0e0 END"


def hash_unit_sql(text: str, part: int) -> str:
    """32 bits of the md5 of a text as a share of 2**32."""
    return f"(('0x' || substr(md5({text}), {1 + 8 * part}, 8))::BIGINT / 4294967296.0e0)"


FLOW_SELECT = ", ".join(s if s == d else f"{s} AS {d}" for s, d in RENAME_MAP.items())
FLOW_COLS = list(RENAME_MAP.values())


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    parts = [f"conn AS (\n{CONN_SQL}\n)", f"flow AS (SELECT {FLOW_SELECT} FROM conn)"]
    parts += [f"{name} AS (\n{q}\n)" for name, q in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + final


def f64(x: float) -> str:
    """A float literal that is a double in both engines."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


# ---------------------------------------------------------------- frequency
def index_parts(c: str, src: str = "flow") -> tuple[list, str, str]:
    """(ctes, join clause, bin expression) of the frequency index of ``c``."""
    ctes = [
        (f"f_{c}", f"SELECT CAST({c} AS VARCHAR) v, count(*) k FROM {src} WHERE {c} IS NOT NULL GROUP BY 1"),
        (f"x_{c}", f"SELECT v, row_number() OVER (ORDER BY k DESC, v) - 1 i, count(*) OVER () nl FROM f_{c}"),
    ]
    join = f"LEFT JOIN x_{c} ON CAST({src}.{c} AS VARCHAR) = x_{c}.v"
    expr = f"CAST(coalesce(x_{c}.i, (SELECT max(nl) FROM x_{c})) AS INT)"
    return ctes, join, expr


def coverage_parts(c: str, pct: float, src: str = "flow") -> tuple[list, str, str]:
    ctes = [
        (f"f_{c}", f"SELECT CAST({c} AS VARCHAR) v, count(*) k FROM {src} WHERE {c} IS NOT NULL GROUP BY 1"),
        (f"x_{c}", f"SELECT v, row_number() OVER (ORDER BY k DESC, v) i, "
                   f"sum(k) OVER (ORDER BY k DESC, v ROWS UNBOUNDED PRECEDING) cum, "
                   f"sum(k) OVER () tot, count(*) OVER () u FROM f_{c}"),
        (f"j_{c}", f"SELECT greatest(coalesce(min(CASE WHEN cum >= tot*{f64(pct)} THEN i END), 1), "
                   f"least({COVERAGE_MIN_TOP}, max(u))) j FROM x_{c}"),
    ]
    join = f"CROSS JOIN j_{c} LEFT JOIN x_{c} ON CAST({src}.{c} AS VARCHAR) = x_{c}.v"
    expr = (f"CAST(CASE WHEN {src}.{c} IS NULL THEN 0 WHEN x_{c}.i <= j_{c}.j THEN x_{c}.i "
            f"ELSE j_{c}.j + 1 END AS INT)")
    return ctes, join, expr


# ---------------------------------------------------------------- numeric
def numeric_stat_ctes(c: str, trim: float = 0.02, src: str = "flow") -> list:
    v = f"CAST({c} AS DOUBLE)"
    o = f"floor(n*{f64(trim)})"
    return [
        (f"r_{c}", f"SELECT {v} v, row_number() OVER (ORDER BY {v}) rn, count(*) OVER () n "
                   f"FROM {src} WHERE {c} IS NOT NULL AND NOT isnan({v})"),
        (f"t_{c}", f"SELECT count(*) nk, avg(v) m, coalesce(stddev_samp(v), 0.0e0) sd, min(v) mn, "
                   f"(SELECT count(*) FROM r_{c}) n_rows FROM r_{c} WHERE rn >= {o} AND rn <= n - {o}"),
        (f"e_{c}", f"SELECT *, CASE WHEN mn < 0 OR m - sd*2 >= 0 THEN m WHEN (m + sd) - sd*2 >= 0 THEN m + sd "
                   f"ELSE (m + sd) + sd END ctr FROM t_{c}"),
    ]


def numeric_bin_expr(c: str, src: str = "flow") -> str:
    x = f"CAST({src}.{c} AS DOUBLE)"
    e = f"e_{c}"
    return (
        f"CAST(CASE WHEN {src}.{c} IS NULL THEN 0 "
        f"WHEN {e}.m IS NULL THEN CASE WHEN isnan({x}) THEN 2 ELSE 1 END "
        f"WHEN {e}.sd = 0 THEN CASE WHEN isnan({x}) THEN 3 WHEN {x} < {e}.ctr THEN 1 ELSE 2 END "
        f"WHEN isnan({x}) THEN 7 "
        f"ELSE 1 + CAST({x} >= {e}.ctr - {e}.sd*2 AS INT) + CAST({x} >= {e}.ctr - {e}.sd AS INT) "
        f"+ CAST({x} >= {e}.ctr AS INT) + CAST({x} >= {e}.ctr + {e}.sd AS INT) "
        f"+ CAST({x} >= {e}.ctr + {e}.sd*2 AS INT) END AS INT)"
    )


def bins_query(ip=(), port=(), index=(), coverage=(), numeric=(), keep=("uid",),
               pct: float = 0.98, trim: float = 0.02, suffix: str = "_bin") -> str:
    ctes, joins, sel = [], [], [f"flow.{k}" for k in keep]
    for c in ip:
        sel.append(f"{ip_class_sql('flow.' + c)} AS {c}{suffix}")
    for c in port:
        sel.append(f"{port_class_sql('flow.' + c)} AS {c}{suffix}")
    for c in index:
        cc, j, e = index_parts(c)
        ctes += cc
        joins.append(j)
        sel.append(f"{e} AS {c}{suffix}")
    for c in coverage:
        cc, j, e = coverage_parts(c, pct)
        ctes += cc
        joins.append(j)
        sel.append(f"{e} AS {c}{suffix}")
    for c in numeric:
        ctes += numeric_stat_ctes(c, trim)
        joins.append(f"CROSS JOIN e_{c}")
        sel.append(f"{numeric_bin_expr(c)} AS {c}{suffix}")
    return with_ctes(ctes, "SELECT " + ", ".join(sel) + " FROM flow " + " ".join(joins))


FULL = dict(ip=IP_COLS, port=PORT_COLS, index=BOOL_COLS + NOMINAL_COLS, numeric=NUMERIC_COLS)


# ---------------------------------------------------------------- rebalance
def rebalance_ctes(pct: float, top: int, src: str = "flow", unit: str | None = None) -> list:
    p = f64(pct)
    unit = unit or hash_unit_sql("f.uid", 0)
    series = "SELECT unnest(generate_series(1, 1000)) k"
    return [
        ("cnt", f"SELECT label_multi l, count(*) a FROM {src} GROUP BY 1"),
        ("nbt", "SELECT coalesce(max(CASE WHEN l = 'none' THEN a END), 0) nb FROM cnt"),
        ("topl", f"SELECT l, a FROM cnt WHERE l <> 'none' ORDER BY a DESC, l LIMIT {top}"),
        ("plan", f"SELECT l AS task, a AS attack_rows, nb AS benign_rows, ((1.0e0 - {p})*a)/{p} AS quota "
                 f"FROM topl CROSS JOIN nbt"),
        ("pp", "SELECT task, attack_rows, benign_rows, quota, (quota % benign_rows)/benign_rows AS frac, "
               "CAST(floor(floor(quota)/benign_rows) AS BIGINT) AS copies FROM plan"),
        ("reb", f"SELECT pp.task, f.* FROM {src} f JOIN pp ON f.label_multi = pp.task "
                f"UNION ALL SELECT pp.task, f.* FROM {src} f CROSS JOIN pp "
                f"WHERE f.label_multi = 'none' AND {unit} < pp.frac "
                f"UNION ALL SELECT pp.task, f.* FROM {src} f CROSS JOIN pp CROSS JOIN ({series}) s "
                "WHERE f.label_multi = 'none' AND s.k <= pp.copies"),
    ]


def numeric_by_group_sql(table: str, key: str, g: str, c: str, trim: float = 0.02) -> str:
    """Per-group std-dev bin of ``table.c`` (plain SQL: windows partitioned by ``g``)."""
    v = f"CAST({c} AS DOUBLE)"
    o = f"floor(n*{f64(trim)})"
    x = f"CAST(t.{c} AS DOUBLE)"
    return (
        f"WITH r AS (SELECT {g} g, {v} v, row_number() OVER (PARTITION BY {g} ORDER BY {v}) rn, "
        f"count(*) OVER (PARTITION BY {g}) n FROM {table} WHERE {c} IS NOT NULL AND NOT isnan({v})),\n"
        f"s AS (SELECT g, avg(v) m, coalesce(stddev_samp(v), 0.0e0) sd, min(v) mn FROM r "
        f"WHERE rn >= {o} AND rn <= n - {o} GROUP BY g),\n"
        f"e AS (SELECT *, CASE WHEN mn < 0 OR m - sd*2 >= 0 THEN m WHEN (m + sd) - sd*2 >= 0 THEN m + sd "
        f"ELSE (m + sd) + sd END ctr FROM s)\n"
        f"SELECT t.{key}, t.{g}, CAST(CASE WHEN t.{c} IS NULL THEN 0 "
        f"WHEN e.sd = 0 THEN CASE WHEN isnan({x}) THEN 3 WHEN {x} < e.ctr THEN 1 ELSE 2 END "
        f"WHEN isnan({x}) THEN 7 "
        f"ELSE 1 + CAST({x} >= e.ctr - e.sd*2 AS INT) + CAST({x} >= e.ctr - e.sd AS INT) "
        f"+ CAST({x} >= e.ctr AS INT) + CAST({x} >= e.ctr + e.sd AS INT) "
        f"+ CAST({x} >= e.ctr + e.sd*2 AS INT) END AS INT) AS {c}_bin "
        f"FROM {table} t JOIN e ON t.{g} = e.g"
    )


def events_bin_sql() -> str:
    idx_ctes, idx_join, idx_expr = index_parts("event_type", "events")
    num_ctes = numeric_stat_ctes("value", 0.02, "events")
    ctes = idx_ctes + num_ctes
    body = ",\n".join(f"{n} AS (\n{q}\n)" for n, q in ctes)
    return (f"WITH {body}\nSELECT events.event_id, {idx_expr} AS event_type_bin, "
            f"{numeric_bin_expr('value', 'events')} AS value_bin FROM events {idx_join} CROSS JOIN e_value")


def null_group_sql() -> str:
    """Price and status bins per priority; the priority 5-LOW has neither."""
    return """
WITH t AS (SELECT o_orderkey, o_orderpriority g, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_totalprice AS DOUBLE) END v,
                  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END s FROM orders),
r AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) rn, count(*) OVER (PARTITION BY g) n FROM t WHERE v IS NOT NULL),
e AS (SELECT g, avg(v) m, coalesce(stddev_samp(v), 0.0e0) sd, min(v) mn FROM r WHERE rn >= floor(n*0.02e0) AND rn <= n - floor(n*0.02e0) GROUP BY g),
c AS (SELECT *, CASE WHEN mn < 0 OR m - sd*2 >= 0 THEN m WHEN (m + sd) - sd*2 >= 0 THEN m + sd ELSE (m + sd) + sd END ctr FROM e),
f AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, s) - 1 i, count(*) OVER (PARTITION BY g) u FROM t WHERE s IS NOT NULL GROUP BY g, s)
SELECT t.o_orderkey, t.g AS o_orderpriority,
       CAST(CASE WHEN t.v IS NULL THEN 0 ELSE 1 + CAST(t.v >= ctr - sd*2 AS INT) + CAST(t.v >= ctr - sd AS INT) + CAST(t.v >= ctr AS INT)
            + CAST(t.v >= ctr + sd AS INT) + CAST(t.v >= ctr + sd*2 AS INT) END AS INT) AS price_bin,
       CAST(CASE WHEN t.s IS NULL THEN coalesce((SELECT max(u) FROM f WHERE f.g = t.g), 0) ELSE f.i END AS INT) AS status_bin
FROM t LEFT JOIN c ON t.g = c.g LEFT JOIN f ON t.g = f.g AND t.s = f.s"""


def runs_sql(models: list[str], prefixes: list[int], binary: bool) -> str:
    """What an experiment's rows must say of tasks, features and test rows; flags are true."""
    order = IP_COLS + PORT_COLS + BOOL_COLS + NOMINAL_COLS + NUMERIC_COLS
    feats = [(n, " ".join(f"{c}_bin" for c in order if c in RANKED[:n])) for n in prefixes]
    values = ", ".join(f"('{m}', {n}, '{f}')" for m in models for n, f in feats)
    if binary:
        ctes = rebalance_ctes(0.3, 10) + [("lab", f"SELECT task AS key, uid, {binary_label_sql()} AS y FROM reb")]
    else:
        ctes = [("rk", "SELECT label_multi l, row_number() OVER (ORDER BY count(*) DESC, label_multi) i FROM flow WHERE label_multi IS NOT NULL GROUP BY 1"),
                ("lab", "SELECT 'All label techniques' AS key, uid, CAST(coalesce(i, 0) AS DOUBLE) AS y FROM flow LEFT JOIN rk ON label_multi = l")]
    ctes += [("big", "SELECT key FROM lab GROUP BY 1 HAVING count(*) >= 500"),
             ("test", f"SELECT key, y, count(*) AS n FROM lab WHERE {hash_unit_sql('uid', 1)} >= 0.7e0 AND key IN (SELECT key FROM big) GROUP BY 1, 2"),
             ("per", "SELECT key, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY y) AS actual, CAST(sum(n) AS BIGINT) AS test_rows FROM test GROUP BY 1"),
             ("run", f"SELECT * FROM (VALUES {values}) AS x(model, num_features, feature_list)")]
    flags = ", ".join(f"true AS {c}_ok" for c in ("accuracy", "recall", "precision", "f_measure", "false_positive", "auc"))
    return with_ctes(ctes, f"SELECT key, model, CAST(num_features AS INT) AS num_features, feature_list, actual, test_rows, {flags} FROM per CROSS JOIN run")


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["rename_flow"] = with_ctes([], "SELECT * FROM flow")
    q["csv_scan"] = with_ctes([], "SELECT * FROM conn")
    q["label_counts"] = with_ctes([], "SELECT label_multi, count(*) AS n FROM flow GROUP BY 1")
    q["top_labels"] = with_ctes([], "SELECT label_multi, count(*) AS n FROM flow WHERE label_multi <> 'none' "
                                    "GROUP BY 1 ORDER BY n DESC, label_multi LIMIT 3")
    q["benign_quota"] = with_ctes(rebalance_ctes(0.3, 10)[:5], "SELECT * FROM pp")
    q["rebalance_undersample"] = with_ctes(rebalance_ctes(0.3, 10), "SELECT * FROM reb")
    q["rebalance_replicate"] = with_ctes(rebalance_ctes(0.05, 10), "SELECT * FROM reb")
    q["label_counts_by_task"] = with_ctes(
        rebalance_ctes(0.3, 10),
        "SELECT task, label_multi, count(*) AS n, sum(count(*)) OVER (PARTITION BY task) AS task_total "
        "FROM reb GROUP BY 1, 2")
    q["task_size_gate"] = with_ctes(
        rebalance_ctes(0.3, 10) + [("big", "SELECT task FROM reb GROUP BY 1 HAVING count(*) >= 500")],
        "SELECT task, uid, label_multi FROM reb WHERE task IN (SELECT task FROM big)")
    q["task_filter"] = with_ctes(
        rebalance_ctes(0.3, 10),
        "SELECT task, uid, label_multi FROM reb WHERE task IN ('Reconnaissance', 'Discovery')")
    q["label_binary"] = with_ctes([], f"SELECT uid, label_multi, {binary_label_sql()} AS label_bin FROM flow")
    cc, j, e = coverage_parts("label_multi", 1.0)
    q["label_multiclass"] = with_ctes(
        cc, f"SELECT flow.uid, flow.label_multi, {e} AS label_multi_bin, CAST({e} AS DOUBLE) AS label_bin "
            f"FROM flow {j}")
    q["ip_class_bin"] = bins_query(ip=IP_COLS, keep=("uid", "src_ip", "dest_ip"))
    q["port_class_bin"] = bins_query(port=PORT_COLS, keep=("uid", "src_port", "dest_port"))
    q["boolean_index"] = bins_query(index=BOOL_COLS)
    q["nominal_index"] = bins_query(index=NOMINAL_COLS)
    q["nominal_coverage_bin"] = bins_query(coverage=NOMINAL_COLS, keep=("uid", "history"), pct=0.98)
    q["nominal_coverage_join"] = q["nominal_coverage_bin"]
    q["numeric_bin_by_group"] = numeric_by_group_sql("orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    q["events_bin"] = events_bin_sql()
    stats_sel = " UNION ALL ".join(
        f"SELECT '{c}' AS cname, n_rows, nk AS n_kept, round(m, 6) AS mean, round(sd, 6) AS sd, "
        f"round(mn, 6) AS minimum FROM t_{c}" for c in NUMERIC_COLS)
    all_stats = [x for c in NUMERIC_COLS for x in numeric_stat_ctes(c)]
    q["trim_stats"] = with_ctes(all_stats, stats_sel)
    edges_sel = " UNION ALL ".join(
        f"SELECT '{c}' AS cname, round(ctr, 6) AS center, round(ctr - sd*2, 6) AS e1, round(ctr - sd, 6) AS e2, "
        f"round(ctr, 6) AS e3, round(ctr + sd, 6) AS e4, round(ctr + sd*2, 6) AS e5 FROM e_{c}"
        for c in NUMERIC_COLS)
    q["numeric_edges"] = with_ctes(all_stats, edges_sel)
    q["numeric_bin"] = bins_query(numeric=NUMERIC_COLS)
    q["full_bin"] = bins_query(**FULL)
    q["full_bin_replace"] = bins_query(
        **FULL, keep=("uid", "ts", "datetime", "community_id", "label_multi"), suffix="")
    bins = [f"{c}_bin" for c in IP_COLS + PORT_COLS + BOOL_COLS + NOMINAL_COLS + NUMERIC_COLS]
    q["feature_distinct_counts"] = (
        q["full_bin"].replace("\nSELECT flow.uid, ", "\n, fb AS (SELECT flow.uid, ", 1)
        + ")\nSELECT " + ", ".join(f"count(DISTINCT {b}) AS {b}" for b in bins) + f" FROM fb WHERE {hash_unit_sql('uid', 1)} < 0.7e0")
    vectors = ", ".join(f"CAST({b} AS DOUBLE)" for b in bins)
    q["feature_vectors"] = (
        bins_query(**FULL, keep=("uid", "label_multi")).replace("\nSELECT flow.uid, ", "\n, fb AS (SELECT flow.uid, ", 1)
        + f")\nSELECT uid, {binary_label_sql()} AS label_bin, [{vectors}] AS features FROM fb")
    q["grouped_bin_null_group"] = null_group_sql()
    text = [c for c in FLOW_COLS if c not in ("uid", "ts", "datetime", "duration")]
    row = "concat_ws('|', " + ", ".join(f"coalesce(CAST(f.{c} AS VARCHAR), '\\N')" for c in text) + ")"
    unit = f"CASE WHEN f.uid IS NULL THEN {hash_unit_sql(row, 0)} ELSE {hash_unit_sql('f.uid', 0)} END"
    half = [("half", "SELECT * REPLACE (CASE WHEN orig_pkts % 2 = 1 THEN uid END AS uid) FROM flow")]
    q["rebalance_null_uid"] = with_ctes(half + rebalance_ctes(0.3, 10, "half", unit), "SELECT task, uid, community_id, label_multi, orig_bytes FROM reb")
    every = [18, 12, 9, 6]
    q["rf_binary"] = runs_sql(["rf"], every, True)
    q["gbt_binary"] = runs_sql(["gbt"], every, True)
    q["rf_multiclass"] = runs_sql(["rf"], [18], False)
    q["ablation"] = runs_sql(["rf"], every, False)
    q["results_append"] = runs_sql(["rf"], [6], True)
    q["hash_split"] = with_ctes(
        [], f"SELECT uid, CASE WHEN {hash_unit_sql('uid', 1)} < 0.7e0 THEN 'train' ELSE 'test' END AS split FROM flow")
    scored = [("scored", SCORED_SQL)]
    q["confusion_matrix"] = with_ctes(
        scored, "SELECT label_bin AS label, prediction, count(*) AS n FROM scored GROUP BY 1, 2")
    metric_ctes = scored + [
        ("cm", "SELECT label_bin AS label, prediction, count(*) AS n FROM scored GROUP BY 1, 2"),
        ("a", "SELECT CAST(sum(n) AS DOUBLE) total, CAST(sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS DOUBLE) correct, "
              "CAST(sum(CASE WHEN label = 1.0e0 AND prediction = 1.0e0 THEN n ELSE 0 END) AS DOUBLE) tp, "
              "CAST(sum(CASE WHEN label <> 1.0e0 AND prediction = 1.0e0 THEN n ELSE 0 END) AS DOUBLE) fp, "
              "CAST(sum(CASE WHEN label = 1.0e0 AND prediction <> 1.0e0 THEN n ELSE 0 END) AS DOUBLE) fn, "
              "CAST(sum(CASE WHEN label <> 1.0e0 AND prediction <> 1.0e0 THEN n ELSE 0 END) AS DOUBLE) tn FROM cm"),
        ("mm", "SELECT CAST(total AS BIGINT) AS n, correct/total AS accuracy, "
               "CASE WHEN tp + fp = 0 THEN 0.0e0 ELSE tp/(tp + fp) END AS precision, "
               "CASE WHEN tp + fn = 0 THEN NULL ELSE tp/(tp + fn) END AS recall, "
               "CASE WHEN tp = 0 THEN 0.0e0 ELSE (2.0e0*tp)/(2.0e0*tp + fp + fn) END AS f_measure, "
               "CASE WHEN fp + tn = 0 THEN NULL ELSE fp/(fp + tn) END AS false_positive FROM a"),
    ]
    q["class_metrics"] = with_ctes(
        metric_ctes,
        "SELECT n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, "
        "round(f_measure, 6) AS f_measure, round(recall, 6) AS true_positive, "
        "round(false_positive, 6) AS false_positive, round((recall + 1.0e0 - false_positive)/2.0e0, 6) AS auc_hard FROM mm")
    q["auc_hard"] = with_ctes(
        metric_ctes, "SELECT round((recall + 1.0e0 - false_positive)/2.0e0, 6) AS auc_hard FROM mm")
    return q
