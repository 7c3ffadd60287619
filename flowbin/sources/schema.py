"""The flow record: required source columns, their types and the rename map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The source-column -> working-column rename map that results
# must agree on (23 entries, in the order of the flow record).
RENAME_MAP: dict[str, str] = {
    "uid": "uid",
    "ts": "ts",
    "datetime": "datetime",
    "community_id": "community_id",
    "src_ip_zeek": "src_ip",
    "dest_ip_zeek": "dest_ip",
    "src_port_zeek": "src_port",
    "dest_port_zeek": "dest_port",
    "local_orig": "local_orig",
    "local_resp": "local_resp",
    "proto": "protocol",
    "conn_state": "conn_state",
    "history": "history",
    "service": "service",
    "duration": "duration",
    "orig_bytes": "orig_bytes",
    "orig_pkts": "orig_pkts",
    "orig_ip_bytes": "orig_ip_bytes",
    "resp_bytes": "resp_bytes",
    "resp_pkts": "resp_pkts",
    "resp_ip_bytes": "resp_ip_bytes",
    "missed_bytes": "missed_bytes",
    "label_tactic": "label_multi",
}

_TYPES: dict[str, T.DataType] = {
    "uid": T.StringType(),
    "ts": T.DoubleType(),
    "datetime": T.TimestampNTZType(),
    "community_id": T.StringType(),
    "src_ip_zeek": T.StringType(),
    "dest_ip_zeek": T.StringType(),
    "src_port_zeek": T.IntegerType(),
    "dest_port_zeek": T.IntegerType(),
    "local_orig": T.BooleanType(),
    "local_resp": T.BooleanType(),
    "proto": T.StringType(),
    "conn_state": T.StringType(),
    "history": T.StringType(),
    "service": T.StringType(),
    "duration": T.DoubleType(),
    "orig_bytes": T.LongType(),
    "orig_pkts": T.LongType(),
    "orig_ip_bytes": T.LongType(),
    "resp_bytes": T.LongType(),
    "resp_pkts": T.LongType(),
    "resp_ip_bytes": T.LongType(),
    "missed_bytes": T.LongType(),
    "label_tactic": T.StringType(),
}

#: Schema of a raw flow table as stored (source names).
FLOW_RAW = T.StructType([T.StructField(c, _TYPES[c], True) for c in RENAME_MAP])

#: Schema after :func:`rename_flow` (working names).
FLOW = T.StructType([T.StructField(RENAME_MAP[c], _TYPES[c], True) for c in RENAME_MAP])

#: Column roles of the working table.
IP_COLS = ["dest_ip", "src_ip"]
PORT_COLS = ["dest_port", "src_port"]
BOOL_COLS = ["local_orig", "local_resp"]
NOMINAL_COLS = ["protocol", "conn_state", "history", "service"]
NUMERIC_COLS = [
    "duration", "orig_bytes", "orig_pkts", "orig_ip_bytes",
    "resp_bytes", "resp_pkts", "resp_ip_bytes", "missed_bytes",
]
LABEL_COL = "label_multi"
BENIGN = "none"
ID_COL = "uid"


class MissingColumnsError(ValueError):
    """Raised when required source columns are absent."""


def require_columns(df: DataFrame, required) -> None:
    """Check all names at once; the error lists every missing column."""
    have = set(df.columns)
    missing = [c for c in required if c not in have]
    if missing:
        raise MissingColumnsError(
            "cannot rename: missing source column(s) " + ", ".join(missing)
        )


def rename_flow(df: DataFrame, rename_map: dict[str, str] = RENAME_MAP) -> DataFrame:
    """Check that every source column exists, then rename in one projection."""
    require_columns(df, rename_map)
    changes = {src: dst for src, dst in rename_map.items() if src != dst}
    return df.withColumnsRenamed(changes)
