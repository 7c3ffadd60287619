"""Hand-made unit rows (FIXTURES.md §5) for the column functions."""

from pyspark.sql import functions as F

from flowbin.functions.classes import ip_class, port_class
from flowbin.functions.labels import binary_label, hash_unit


def test_ip_class_rows(spark):
    vals = [None, "", "fe80::1", "0.1.1.1", "127.0.0.1", "128.0.0.1", "191.1.1.1", "192.1.1.1",
            "224.0.0.1", "240.0.0.1", "254.1.1.1", "255.1.1.1", "::ffff:1.2.3.4", "-1.0.0.0"]
    want = [0, 0, 0, 1, 1, 2, 2, 3, 4, 5, 5, 6, 0, 2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, ip string")
    got = [r["b"] for r in df.select("i", ip_class("ip").alias("b")).orderBy("i").collect()]
    assert got == want


def test_port_class_rows_int_and_text(spark):
    ints = [None, 0, 1023, 1024, 49151, 49152, 65535, 65536, -1]
    want = [0, 1, 1, 2, 2, 3, 3, 4, 2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ints)], "i int, p int")
    assert [r["b"] for r in df.select("i", port_class("p").alias("b")).orderBy("i").collect()] == want
    txt = spark.createDataFrame([(0, "x"), (1, "80"), (2, None)], "i int, p string")
    assert [r["b"] for r in txt.select("i", port_class("p").alias("b")).orderBy("i").collect()] == [0, 1, 0]


def test_binary_label_null_is_benign(spark):
    df = spark.createDataFrame([("none",), ("Discovery",), (None,)], "l string")
    got = [r["b"] for r in df.select(binary_label("l").alias("b")).collect()]
    assert got == [1.0, 0.0, 1.0]


def test_hash_unit_range_and_parts(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("uid"))
    r = df.select(F.min(hash_unit("uid", 0)).alias("lo"), F.max(hash_unit("uid", 0)).alias("hi"),
                  F.corr(hash_unit("uid", 0), hash_unit("uid", 1)).alias("c")).first()
    assert 0.0 <= r["lo"] < 0.01 and 0.99 < r["hi"] < 1.0
    assert abs(r["c"]) < 0.1  # sample bits and split bits are independent
