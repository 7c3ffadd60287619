"""Column statistics as one mergeable table, built in a single pass over the rows.

``column_state`` counts, for each group and column, the values of frequency columns and the
buckets of numeric ones.  A bucket is a power of two cut into equal steps: its number grows
with the value, so the counts of buckets give every rank of a column up to one bucket, exactly.
Counts of two tables add up, so states of parts of the data (days, shards) merge by a sum.

A null (for numbers also NaN) is counted as a row without value and bucket: every group of the
data has a row for each column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets to each doubling of a numeric value.
ACCURACY = 1024
#: Added to the exponent of two of a double, whose least is -1074.
LEAST_EXPONENT = 1100
#: Exponent that stands for infinity.
INFINITE = 1100


def steps_of(accuracy: int) -> int:
    """The largest power of two up to ``accuracy``."""
    return 1 << max(0, int(accuracy).bit_length() - 1)


def bucket(value: Column, accuracy: int = ACCURACY) -> Column:
    """Number of a double's bucket, which never falls as the value grows; null for null and NaN."""
    steps = steps_of(accuracy)
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    # an exponent that rounding puts one too high or low gives the same number
    within = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * steps)
    code = F.when(size == float("inf"), F.lit((INFINITE + LEAST_EXPONENT) * steps)).otherwise((exponent + LEAST_EXPONENT) * steps + within) + 1
    return F.when(value.isNull() | F.isnan(value), F.lit(None)).when(value > 0, code).when(value < 0, -code).otherwise(F.lit(0)).cast("long")


def column_state(df: DataFrame, frequency: list[str], numeric: list[str], by: list[str] | None = None,
                 accuracy: int = ACCURACY) -> DataFrame:
    """(by..., cname, v, b, k, mn, mx): rows of each value ``v`` (as string) or bucket ``b`` of a
    column, and the least and greatest number in a bucket."""
    by = list(by or [])
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    items = [F.struct(F.lit(c).alias("cname"), F.col(c).cast("string").alias("v"), no_number.alias("x")) for c in dict.fromkeys(frequency)]
    items += [F.struct(F.lit(c).alias("cname"), no_text.alias("v"), F.col(c).cast("double").alias("x")) for c in dict.fromkeys(numeric)]
    # the bucket is an expression of the unpivoted value: once in the generated code, not once a column
    long = df.select(*by, F.inline(F.array(*items))).withColumn("b", bucket(F.col("x"), accuracy))
    number = F.when(F.col("b").isNotNull(), F.col("x"))
    return long.groupBy(*by, "cname", "v", "b").agg(F.count(F.lit(1)).alias("k"), F.min(number).alias("mn"), F.max(number).alias("mx"))


def merge_states(states: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """The state of all rows from the states of parts of them."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*(by or []), "cname", "v", "b").agg(F.sum("k").alias("k"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "") -> Column:
    """Equality of all keys, null equal to null; the right side's names may have a prefix."""
    cond = F.lit(True)
    for c in keys:
        cond = cond & left[c].eqNullSafe(right[prefix + c])
    return cond
