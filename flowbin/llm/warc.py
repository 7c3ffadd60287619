"""WARC archives: writing pages as records, and reading them back by boundary chains.

Writing.  Each page is one record.  Of pages with equal payloads of at least
``REVISIT_BYTES`` bytes the one with the least id is a response, the others are revisits of
it without the payload; smaller payloads are always responses.  A record ends with two line
ends, which is the line separator of Spark's text writer, so that the archives go through
Spark's own commit to any file system it can write.

Reading.  Spark splits the archives at the record magic, wherever it stands.  Each task
gives the place of every candidate inside its split, its header, and the place of its
successor, which the header's length decides; the lengths of the splits of a file turn
places into offsets.  A magic inside a payload makes a candidate too, so the chain from the
start of each file decides: pointer jumping doubles the reach of every candidate's link, and
only the candidates that the file start reaches are records.  Their payloads are cut by
length, over several pieces where a payload holds the magic.

Defined results: a null or empty payload is an empty one (a response); repeated rows are
records of their own, the revisits naming the least id; rows with a null id are written and
come back with a null id, and are named by none; a null url is left out, line ends in it are
percent-encoded; an empty table gives no archive.  Further columns are not archived.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbin.llm.frames import settle
from flowbin.session import shared_scratch

MAGIC = "WARC/1.0\r\n"
REVISIT_BYTES = 100
BROADCAST_ROWS = 200_000
_GAP = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows (id, url, payload, digest, n_bytes, refers_to): which pages revisit which."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    large = rows.where((F.col("n_bytes") >= REVISIT_BYTES) & F.col("id").isNotNull()).select("digest", "id")
    again = settle(large.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"))
    if again.count() <= BROADCAST_ROWS:  # repeated payloads; about 100 bytes a row
        again = F.broadcast(again)
    found = rows.join(again, "digest", "left")
    return found.select("id", "url", "payload", "digest", "n_bytes", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))


def record(rows: DataFrame) -> Column:
    """The text of each record without its final two line ends."""
    head = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        head("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))),
        head("WARC-Target-URI", url), head("WARC-Page-ID", F.col("id")), head("WARC-Refers-To-Page-ID", F.col("refers_to")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("n_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_GAP), block)


def write(pages: DataFrame, path: str, **columns: str) -> None:
    """Write the pages as archives in the folder ``path`` (one file for each task)."""
    rows = plan(pages, **columns)
    rows.select(record(rows).alias("value")).write.option("lineSep", _GAP).text(path)


def _header(piece: bytes) -> tuple[int, dict[str, str]] | None:
    """Length of a record's header after the magic and its fields, or None if it is none."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b": ")
        if not colon:
            return None
        fields[name.decode("latin-1").lower()] = value.decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        return None
    return end + 4, fields


_PIECES = T.StructType([
    T.StructField("file", T.LongType()), T.StructField("split", T.LongType()), T.StructField("place", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("next", T.LongType()), T.StructField("body", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("kind", T.StringType()),
    T.StructField("id", T.LongType()), T.StructField("refers_to", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("content", T.BinaryType())])


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _split_pieces(want: str, schema: pa.Schema):
    """The pieces between magics of a task's splits, in file order, as candidates for records.

    place: first byte after the magic, counted from the split's first piece; next: the place
    of the successor's magic, and body: where the payload begins, if the piece heads a record.
    content: the payload if the piece holds all of it (want "payload"), the piece (want
    "piece"), or null.
    """
    def run(batches):
        now, place = None, 0
        for b in batches:
            rows = []
            for value, file, split in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (file, split) != now:
                    now, place = (file, split), 0
                piece = value.as_py()
                size = len(piece) + len(MAGIC)
                content = piece if want == "piece" else None
                head = _header(piece)
                if head is None:
                    rows.append((file, split, place, size, *[None] * 9, content))
                else:
                    skip, f = head
                    end = skip + int(f["content-length"])
                    gap = piece.find(b"\r\n\r\n", skip, end)
                    body = end if gap < 0 else gap + 4
                    if want == "payload" and end <= len(piece):
                        content = piece[body:end]
                    rows.append((file, split, place, size, place + end + len(_GAP), place + body, end <= len(piece), f.get("warc-type"),
                                 _number(f.get("warc-page-id")), _number(f.get("warc-refers-to-page-id")), f.get("warc-payload-digest", "").removeprefix("sha256:"),
                                 _number(f.get("warc-payload-length")), f.get("warc-target-uri"), content))
                place += size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of the candidates that each file's offset 0 reaches over (file, offset, next).

    Pointer jumping: after round k the links span 2**k records and twice as many are reached.
    """
    jump = settle(links.select("file", "offset", "next"))
    reached = settle(jump.where("offset = 0").select("file", "offset"))
    while True:
        to = reached.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        new = settle(to.join(links.select("file", "offset"), ["file", "offset"]))
        if new.isEmpty():
            return reached
        reached = settle(reached.unionByName(new))
        onward = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        jump = settle(jump.join(onward, ["file", "next"]).select("file", "offset", F.col("after").alias("next")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: id, url, kind, refers_to, digest, n_bytes (both
    as the header names them) and payload (binary; empty for a revisit).

    Raises ValueError if the chain of an archive does not end at its last byte; a payload that
    does not have its header's digest fails the job that reads it.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    pieces = lambda want: raw.mapInArrow(_split_pieces(want, to_arrow_schema(_PIECES)), _PIECES)
    index = settle(pieces("none").select("file", "split", "place", "size", "next", "whole"))
    size = index.groupBy("file", "split").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = settle(size.select("file", "split", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), "size"))
    m = len(MAGIC)
    placed = index.where("next IS NOT NULL").join(base.drop("size"), ["file", "split"])
    placed = settle(placed.select("file", "split", "place", "whole", (F.col("base") + F.col("place") - m).alias("offset"), (F.col("base") + F.col("next")).alias("next")))
    reached = reachable(placed)
    records = placed.join(reached, ["file", "offset"])
    length = base.groupBy("file").agg((F.sum("size") - m).alias("length"))
    ends = records.groupBy("file").agg(F.max("next").alias("end"))
    broken = length.where("length > 0").join(ends, "file", "left").where("end IS NULL OR end != length")
    if not broken.isEmpty():
        raise ValueError(f"{broken.count()} archives are cut short or damaged")

    key = ["file", "split", "place"]
    found = pieces("payload").where("kind IS NOT NULL")
    torn = settle(placed.join(reached, ["file", "offset"], "left_anti").select(key))
    if not torn.isEmpty():
        found = found.join(F.broadcast(torn) if torn.count() <= BROADCAST_ROWS else torn, key, "left_anti")
    part = settle(records.where("NOT whole").select(*key, "offset", "next"))
    fields = ["id", "url", "kind", "refers_to", "digest", "n_bytes"]
    if part.isEmpty():
        return _proved(found.select(*fields, F.col("content").alias("payload")))
    # payloads over several pieces: the record's own and those up to its end, joined by the magic
    heads = part.select(*key, "offset", "next")
    loose = pieces("piece").join(F.broadcast(base.drop("size")) if base.count() <= BROADCAST_ROWS else base.drop("size"), ["file", "split"])
    loose = loose.drop("next").join(heads, key, "left").where("offset IS NOT NULL OR kind IS NULL").unionByName(
        # torn pieces without a type are in already
        loose.drop("next").where("kind IS NOT NULL").join(torn, key).withColumn("offset", F.lit(None).cast("long")).withColumn("next", F.lit(None).cast("long")))
    along = Window.partitionBy("file").orderBy("at")
    loose = loose.withColumn("at", F.col("base") + F.col("place"))
    loose = loose.withColumn("of", F.last("offset", True).over(along)).withColumn("end", F.last("next", True).over(along)).where("at < end")
    whole = loose.groupBy("file", "of").agg(
        F.array_sort(F.collect_list(F.struct("at", "content"))).alias("parts"), F.max("end").alias("end"),
        *[F.max(F.when(F.col("offset").isNotNull(), F.col(c))).alias(c) for c in ("id", "url", "kind", "refers_to", "digest", "n_bytes", "body", "base")])
    text = F.array_join(F.transform("parts", lambda p: F.hex(p["content"])), MAGIC.encode().hex().upper())
    at = F.col("parts")[0]["at"]
    begin, stop = F.col("base") + F.col("body") - at, F.col("end") - len(_GAP) - at
    payload = F.unhex(F.expr("x").substr(2 * F.col("skip") + 1, 2 * F.col("n")))
    whole = whole.withColumn("x", text).withColumn("skip", begin.cast("int")).withColumn("n", (stop - begin).cast("int"))
    both = found.join(F.broadcast(part.select(key)) if part.count() <= BROADCAST_ROWS else part.select(key), key, "left_anti")
    return _proved(both.select(*fields, F.col("content").alias("payload")).unionByName(whole.select(*fields, payload.alias("payload"))))


def _proved(records: DataFrame) -> DataFrame:
    """The records; one whose payload is not what its header's digest says fails the job."""
    told = (F.col("kind") == "response") & (F.length("digest") == 64)
    wrong = F.concat(F.lit("payload does not have the digest of its header, page "), F.coalesce(F.col("id").cast("string"), F.lit("none")))
    payload = F.when(told & (F.sha2("payload", 256) != F.col("digest")), F.raise_error(wrong).cast("binary")).otherwise(F.col("payload"))
    return records.withColumn("payload", payload)


def archive(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` to the shared checkpoint folder as archives and read them back."""
    spark = pages.sparkSession
    path = shared_scratch(spark, "archives")
    write(pages, path, **columns)
    return read(spark, path)
