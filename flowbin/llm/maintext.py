"""Main text of web pages: markup where it decides, a host's suffix array where it does not.

A page is cut into blocks.  Blocks inside an ``article`` (else ``main``) element are the main
text, but for parts marked as menus, headers, footers, sidebars, notices, adverts, forms or
reader comments.  Parts marked so elsewhere are boilerplate.  All other text is open.

Open text is decided by the host.  The token streams of all text outside the main elements
are laid together by host, and a suffix array finds the runs of ``RUN`` tokens or more that
stand on two distinct pages of the host or more.  An open block is boilerplate if half of
its tokens or more are covered; the unique runs stay.  Pages with equal streams count as
one, so that copies of a page do not wipe each other out.

A host of any size is split without loss: the streams are cut at the least token hash of
every window of ``RUN`` tokens, and equal windows meet under that token whatever their page.
Within a task equal cuts are sent once.

Defined results: a null or empty html has the empty text; repeated rows have equal results;
a null url is a host of its own kind; a page cut short ends where it ends.  Character
references are decoded; white space in a block becomes one space; blocks are joined by an
empty line.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbin.llm import textscan as scan
from flowbin.llm.decontam import suffix_array
from flowbin.llm.frames import settle

RUN = 8
COVERED = 0.5
CHUNK_TOKENS = 500_000
BROADCAST_PAGES = 10_000
MAIN, BOILER, OPEN = 0, 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = frozenset("script style template noscript textarea title svg iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_BOILER_TAGS = frozenset("nav header footer aside form head menu dialog button select".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_BOILER_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
                          "header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related respond "
                          "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_CLOSES_P = _BLOCK - {"body", "html", "head"}


def _marked(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is marked as boilerplate, and whether its role is main."""
    if tag in _BOILER_TAGS:
        return True, False
    if not attributes or not attributes.strip("/ "):
        return False, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role":
            if value == "main":
                return False, True
            if value in _BOILER_ROLES:
                return True, False
        elif name in ("class", "id") and tag not in ("body", "html", "main", "article") and not _BOILER_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True, False
        elif name in ("class", "id") and tag == "article" and not {"comment", "comments"}.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True, False
    return False, False


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page, empty ones left out."""
    found: list[tuple[bool, bool, bool, str]] = []  # boiler, in article, in main, text
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, boiler, article, main = stack[-1]
                found.append((boiler, article, main, text))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in _BLOCK:
                flush()
            if depth and tag in _BLOCK:
                del stack[depth:]
            continue
        if tag in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag in _CLOSES_P and stack[-1][0] == "p":
                stack.pop()
            if tag == "li" and stack[-1][0] == "li":
                stack.pop()
            boiler, is_main = _marked(tag, m[3])
            _, b, a, c = stack[-1]
            if tag not in _VOID and not m[3].endswith("/"):
                stack.append((tag, b or boiler, a or (tag == "article" and not boiler), c or tag == "main" or is_main))
        elif tag == "button":
            end = re.compile(r"</button\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
    flush()
    inside = 1 if any(a and not b for b, a, _, _ in found) else 2 if any(c and not b for b, _, c, _ in found) else 0
    return [(BOILER if x[0] else MAIN if inside and x[inside] else OPEN, x[3]) for x in found]


def _stream(found: list[tuple[int, str]]) -> tuple[list[str], list[int]]:
    """Tokens outside the main text and the block of each."""
    tokens, of = [], []
    for i, (kind, text) in enumerate(found):
        if kind != MAIN:
            own = text.split()
            tokens += own
            of += [i] * len(own)
    return tokens, of


def cuts(tokens: list[str], host: str) -> list[tuple[int, int, int, np.ndarray]]:
    """Runs of windows that share their least token: (least hash, first, hash of the run, tokens)."""
    if len(tokens) < RUN:
        return []
    data, off = scan.buffers(pa.array([host, *tokens], pa.string()))
    salted = scan.span_hash(scan.mix(data.astype(np.uint64), 61), off[:-1], off[1:])
    h = scan.mix(salted[1:] ^ salted[0], 62)  # tokens of different hosts differ
    views = np.lib.stride_tricks.sliding_window_view(h, RUN)
    least = views.argmin(1) + np.arange(len(views))
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(views)) + RUN - 1
    name = scan.span_hash(h, first, last)
    return [(int(h[least[a]].view(np.int64)), int(a), int(x.view(np.int64)), h[a:b].view(np.int64)) for a, b, x in zip(first, last, name, strict=True)]


_CUTS = T.StructType([T.StructField("least", T.LongType()), T.StructField("run", T.LongType()), T.StructField("page", T.LongType()),
                      T.StructField("tokens", T.ArrayType(T.LongType()))])
_SEEN = T.StructType([T.StructField("run", T.LongType()), T.StructField("id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("first", T.LongType())])
_COVER = T.StructType([T.StructField("run", T.LongType()), T.StructField("covered", T.ArrayType(T.BooleanType()))])
_TEXT = T.StructType([T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])


def _records(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _pages(batches):
    for b in scan.slices(batches, "html"):
        d = b.to_pydict()
        for i in range(b.num_rows):
            yield {k: v[i] for k, v in d.items()} | {"blocks": blocks(d["html"][i] or "")}


def _emit_cuts(schema: pa.Schema):
    """The cuts of all streams; of equal cuts of a task two, from two pages, are enough."""
    def run(batches):
        for b in scan.slices(batches, "html"):
            seen: dict[int, set[int]] = {}
            rows = []
            for page in _pages(iter([b])):
                tokens, _ = _stream(page["blocks"])
                own = cuts(tokens, page["host"] or "")
                name = hash(tuple(x[2] for x in own))  # of ints: the same in every process
                for least, _, run_, values in own:
                    pages = seen.setdefault(run_, set())
                    if name not in pages and len(pages) < 2:
                        pages.add(name)
                        rows.append((least, run_, name, values))
            yield _records(schema, rows)

    return run


def _find(rows: list[tuple[int, int, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    """Suffix array over the cuts of whole groups: what stands on two pages or more."""
    size = np.array([len(x[2]) for x in rows])
    h = np.concatenate([x[2] for x in rows]).view(np.uint64)
    stop = np.cumsum(size)
    end = np.repeat(stop, size)
    page = np.repeat(np.array([x[1] for x in rows]), size)
    at = np.arange(len(h))
    sa = suffix_array(h, end, at[at + RUN <= end], RUN)
    key = scan.span_hash(h, sa, sa + RUN)
    group = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(sa) else sa
    p = page[sa]
    many = np.maximum.reduceat(p, group) != np.minimum.reduceat(p, group) if len(sa) else np.zeros(0, bool)
    hit = sa[np.repeat(many, np.diff(np.append(group, len(sa))))]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + RUN, -1)
    covered = np.cumsum(edge[:-1]) > 0
    out = {}
    for (run_, _, values), s in zip(rows, stop, strict=True):
        flags = covered[s - len(values) : s]
        if flags.any() and run_ not in out:
            out[run_] = flags.tolist()
    return _records(schema, list(out.items()))


def _emit_cover(schema: pa.Schema):
    """Rows come sorted by their least token; groups are never split over two arrays."""
    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            d = b.to_pydict()
            for least, run_, page, values in zip(d["least"], d["run"], d["page"], d["tokens"], strict=True):
                if size > CHUNK_TOKENS and least != last:
                    yield _find(rows, schema)
                    rows, size = [], 0
                rows.append((run_, page, np.array(values, np.int64)))
                size, last = size + len(values), least
        if rows:
            yield _find(rows, schema)

    return run


def _emit_seen(schema: pa.Schema):
    """The cuts of pages with open text, by page."""
    def run(batches):
        for b in scan.slices(batches, "html"):
            rows = []
            for page in _pages(iter([b])):
                if any(kind == OPEN for kind, _ in page["blocks"]):
                    rows.append((0, page["id"], page["key"], 0))  # stands for the page
                    rows += [(run_, page["id"], page["key"], first) for _, first, run_, _ in cuts(_stream(page["blocks"])[0], page["host"] or "")]
            yield _records(schema, rows)

    return run


def _emit_text(open_pages: bool, schema: pa.Schema):
    def run(batches):
        for b in scan.slices(batches, "html"):
            rows = []
            for page in _pages(iter([b])):
                found = page["blocks"]
                if any(kind == OPEN for kind, _ in found) != open_pages:
                    continue
                keep = [text for kind, text in found if kind == MAIN]
                if open_pages:
                    _, of = _stream(found)
                    of = np.array(of, np.int64)
                    covered = np.zeros(len(of), bool)
                    for first, flags in ((x["first"], x["covered"]) for x in page["covers"] or []):
                        covered[first : first + len(flags)] |= np.array(flags, bool)
                    n, hit = np.bincount(of, minlength=len(found)), np.bincount(of[covered], minlength=len(found))
                    keep = [text for i, (kind, text) in enumerate(found) if kind == MAIN or kind == OPEN and hit[i] < COVERED * max(n[i], 1)]
                rows.append((page["id"], page["url"], "\n\n".join(keep)))
            yield _records(schema, rows)

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page id, url, text) for every page; the columns keep their names and ``text`` is new."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))).withColumn("key", F.xxhash64("id", "url", "html"))
    closed = rows.mapInArrow(_emit_text(False, to_arrow_schema(_TEXT)), _TEXT)

    seen = settle(rows.mapInArrow(_emit_seen(to_arrow_schema(_SEEN)), _SEEN))
    sent = rows.mapInArrow(_emit_cuts(to_arrow_schema(_CUTS)), _CUTS)
    cover = sent.repartition("least").sortWithinPartitions("least").mapInArrow(_emit_cover(to_arrow_schema(_COVER)), _COVER)
    cover = cover.dropDuplicates(["run"])
    covers = seen.where("run != 0").join(cover, "run").groupBy("id", "key").agg(F.collect_list(F.struct("first", "covered")).alias("covers"))
    wanted = seen.select("id", "key").distinct()
    covers = settle(wanted.join(covers, ["id", "key"], "left"))
    if covers.count() <= BROADCAST_PAGES:  # else all pages are dealt out for the join
        covers = F.broadcast(covers)
    same = rows["id"].eqNullSafe(covers["id"]) & (rows["key"] == covers["key"])
    undecided = rows.join(covers, same).select(rows["*"], "covers")
    texts = closed.unionByName(undecided.mapInArrow(_emit_text(True, to_arrow_schema(_TEXT)), _TEXT))
    return texts.select(F.col("id").cast(pages.schema[id_col].dataType).alias(id_col), F.col("url").alias(url_col), "text")
