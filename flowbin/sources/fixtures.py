"""Test fixtures derived from the driver's read-only tables.

``conn`` is a raw flow table built from ``lineitem`` (FIXTURES.md §2) and
``scored`` a rule-made prediction over it (FIXTURES.md §3).  The select lists
are kept once and used twice: as Spark expressions and as the text of the
DuckDB oracle, so both engines see the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowbin.sources.splits import read_parquet

_LABEL_KEY = "(l_orderkey*31 + l_linenumber*7 + l_partkey) % 1000"

CONN_SELECT: list[tuple[str, str]] = [
    ("concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', "
     "CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', "
     "CAST(CAST(l_quantity AS INT) AS STRING))", "uid"),
    ("CAST(l_orderkey AS DOUBLE)", "ts"),
    ("l_shipdate", "datetime"),
    ("concat('1:', CAST(l_orderkey AS STRING))", "community_id"),
    ("CASE WHEN l_suppkey % 29 = 0 THEN NULL WHEN l_suppkey % 31 = 0 THEN 'fe80::1' "
     "ELSE concat(CAST((l_suppkey*37 + l_linenumber*11) % 256 AS STRING), '.0.0.', "
     "CAST(l_linenumber AS STRING)) END", "src_ip_zeek"),
    ("concat(CAST(l_partkey % 256 AS STRING), '.168.0.1')", "dest_ip_zeek"),
    ("CAST(CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE (l_orderkey*97) % 65536 END AS INT)",
     "src_port_zeek"),
    ("CAST(CASE WHEN l_partkey % 3 = 0 THEN 443 WHEN l_partkey % 3 = 1 THEN 8080 "
     "ELSE (l_partkey*613) % 70000 END AS INT)", "dest_port_zeek"),
    ("l_returnflag = 'A'", "local_orig"),
    ("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus = 'O' END", "local_resp"),
    ("CASE WHEN l_quantity < 30 THEN 'tcp' WHEN l_quantity < 45 THEN 'udp' ELSE 'icmp' END",
     "proto"),
    ("CASE WHEN l_linenumber <= 2 THEN 'SF' WHEN l_linenumber <= 4 THEN 'S0' "
     "WHEN l_linenumber = 5 THEN 'REJ' ELSE 'OTH' END", "conn_state"),
    ("concat('Sh', CAST(l_suppkey % 23 AS STRING))", "history"),
    ("CASE WHEN l_partkey % 5 < 2 THEN NULL WHEN l_partkey % 5 = 2 THEN 'dns' "
     "WHEN l_partkey % 5 = 3 THEN 'http' ELSE 'ssl' END", "service"),
    ("CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_extendedprice / 1000.0 END", "duration"),
    ("CAST(floor(l_extendedprice) AS BIGINT)", "orig_bytes"),
    ("CAST(floor(l_quantity) AS BIGINT)", "orig_pkts"),
    ("CAST(floor(l_extendedprice + l_quantity*40) AS BIGINT)", "orig_ip_bytes"),
    ("CAST(floor(l_extendedprice * l_discount) AS BIGINT)", "resp_bytes"),
    ("CAST(floor(l_quantity * l_tax * 10) AS BIGINT)", "resp_pkts"),
    ("CAST(floor(l_extendedprice * l_tax) AS BIGINT)", "resp_ip_bytes"),
    ("CAST(0 AS BIGINT)", "missed_bytes"),
    (f"CASE WHEN {_LABEL_KEY} < 800 THEN 'none' "
     f"WHEN {_LABEL_KEY} < 900 THEN 'Reconnaissance' "
     f"WHEN {_LABEL_KEY} < 960 THEN 'Discovery' "
     f"WHEN {_LABEL_KEY} < 985 THEN 'Credential Access' "
     f"WHEN {_LABEL_KEY} < 997 THEN 'Privilege Escalation' ELSE NULL END", "label_tactic"),
]

SCORED_SELECT: list[tuple[str, str]] = [
    ("uid", "uid"),
    ("CASE WHEN label_tactic <> 'none' THEN 0.0e0 ELSE 1.0e0 END", "label_bin"),
    ("CASE WHEN orig_pkts < 30 OR service = 'dns' THEN 1.0e0 ELSE 0.0e0 END", "prediction"),
]


def _select_sql(select: list[tuple[str, str]]) -> str:
    return ",\n  ".join(f"{e} AS {a}" for e, a in select)


CONN_SQL = "SELECT\n  " + _select_sql(CONN_SELECT) + "\nFROM lineitem"
SCORED_SQL = "SELECT " + _select_sql(SCORED_SELECT) + " FROM conn"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw flow fixture (source column names) over the whole ``lineitem``."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {a}" for e, a in CONN_SELECT])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, label_bin, prediction) with a rule-made prediction."""
    return conn(spark, sf_dir).selectExpr(*[f"{e} AS {a}" for e, a in SCORED_SELECT])


def with_conn(sql: str) -> str:
    """Prefix an oracle query with the ``conn`` CTE (only raw tables are registered)."""
    return f"WITH conn AS (\n{CONN_SQL}\n)\n{sql}"
