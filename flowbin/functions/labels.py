"""Label and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 2**32: the hash unit is a 32-bit bucket divided by this.
_TWO32 = 4294967296.0


def binary_label(label_col: str = "label_multi", benign: str = "none",
                 attack_value: float = 0.0, benign_value: float = 1.0) -> Column:
    """Attack rows get ``attack_value``, benign rows ``benign_value``.

    A null label is not ``!= benign`` (the comparison is null), so it lands on
    ``benign_value`` - the same as the reference's ``when/otherwise``.
    """
    return (
        F.when(F.col(label_col) != F.lit(benign), F.lit(attack_value))
        .otherwise(F.lit(benign_value))
        .cast("double")
    )


def hash_unit(id_col: str = "uid", part: int = 0) -> Column:
    """A number in [0, 1) from 32 bits of ``md5(id)``; ``part`` picks which 32 bits.

    Deterministic for a row whatever the partitioning, so samples and splits
    repeat exactly.  Part 0 drives the benign sample, part 1 the train/test
    split, so the two are independent.
    """
    start = 1 + 8 * part
    bucket = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), start, 8), 16, 10).cast("bigint")
    return bucket.cast("double") / F.lit(_TWO32)


def row_unit(df: DataFrame, id_col: str = "uid", part: int = 0) -> Column:
    """:func:`hash_unit` of the id, or of the row where the id is null.

    The row is hashed by its string, integer and boolean columns, whose text form
    is the same everywhere.  Rows without an id are thus sampled at the same rate as
    others; rows without an id that are equal in these columns go together.
    """
    exact = (T.StringType, T.IntegerType, T.LongType, T.BooleanType)
    names = [f.name for f in df.schema.fields if f.name != id_col and isinstance(f.dataType, exact)]
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in names]
    start = 1 + 8 * part
    whole = F.conv(F.substring(F.md5(F.concat_ws("|", *values)), start, 8), 16, 10).cast("bigint").cast("double") / F.lit(_TWO32)
    return F.when(F.col(id_col).isNull(), whole).otherwise(hash_unit(id_col, part))
