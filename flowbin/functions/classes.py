"""IP-address and port class bins as native column expressions.

Both replace row-at-a-time Python UDFs with ``try_cast`` + ``CASE`` so the
whole projection stays inside whole-stage codegen.  Null or unparsable input
gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (inclusive) of the address classes on the first
# octet, A=1 .. E=5; above the last bound the class is 6.
IP_CLASS_UPPER = [127, 191, 223, 239, 254]

# Upper bounds (inclusive) of the port ranges: well known = 1,
# registered = 2, dynamic/private = 3; above the last bound the class is 4.
PORT_CLASS_UPPER = [1023, 49151, 65535]


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _classify(n: Column, uppers: list[int]) -> Column:
    """1 for 0..uppers[0]; k+1 for values up to uppers[k]; len+1 above.

    Only the first range tests ``>= 0``: negative numbers fall through to 2.
    """
    expr = F.when((n >= 0) & (n <= uppers[0]), F.lit(1))
    for k, upper in enumerate(uppers[1:], start=2):
        expr = expr.when(n <= upper, F.lit(k))
    return expr.otherwise(F.lit(len(uppers) + 1))


def ip_first_field(c) -> Column:
    """First dot-separated field of an address as a number; null when the
    text has no dot or that field is not an integer."""
    s = _as_col(c).cast("string")
    return F.when(F.instr(s, ".") > 0, F.substring_index(s, ".", 1).try_cast("bigint"))


def port_number(c) -> Column:
    """A port as a number; null when missing or not an integer."""
    return _as_col(c).try_cast("bigint")


def ip_class_of(n: Column) -> Column:
    """Class from a parsed first field (see :func:`ip_first_field`); null gives 0."""
    return F.when(n.isNull(), F.lit(0)).otherwise(_classify(n, IP_CLASS_UPPER)).cast("int")


def port_class_of(n: Column) -> Column:
    """Class from a parsed port (see :func:`port_number`); null gives 0."""
    return F.when(n.isNull(), F.lit(0)).otherwise(_classify(n, PORT_CLASS_UPPER)).cast("int")


def ip_class(c) -> Column:
    """Address class of a dotted address string from its first field.

    No dot, null or a first field that is not an integer: 0.  For many
    columns at once prefer projecting :func:`ip_first_field` first and then
    :func:`ip_class_of` on it, so the parse runs once per row.
    """
    return ip_class_of(ip_first_field(c))


def port_class(c) -> Column:
    """Port range class; null or non-integer text: 0."""
    return port_class_of(port_number(c))
