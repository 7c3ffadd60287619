"""WARC archives, main text and tool calls: round trips, odd inputs, and SQL."""

import hashlib
import json
import os
import re

import pytest

from flowbin.llm import maintext, toolcalls, warc
from flowbin.session import shared_scratch

SF001 = "/root/testdata/sf0.001"
UNTYPED = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc "
RECORD = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize(("parts", "split"), [(1, "64"), (1, "200m"), (3, "300")])
def test_archives_round_trip_with_magic_inside(spark, parts, split):
    rows = [(1, "u", "x" * 120), (2, "u\r\nv", "x" * 120), (3, None, None), (4, "u", RECORD * 2), (5, "u", "aWARC/1.0\r\nbWARC/1.0\r\n"), (6, "u", ""),
            (7, "u", RECORD * 2), (None, "u", "x" * 120), (8, "é", "é\r\n\r\nWARC/1.0\r\n" * 30), (9, "u", "WARC/1.0\r\n"), (9, "u", "WARC/1.0\r\n"),
            (10, "u", "head " + UNTYPED * 2 + "tail " + "y" * 90), (11, "u", UNTYPED * 3), (12, "u", UNTYPED + RECORD + UNTYPED + "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = warc.archive(df).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.id or 0, r.kind, r.refers_to) for r in got) == sorted(
        [(i or 0, "revisit" if i in (2, 7) else "response", {2: 1, 7: 4}.get(i)) for i, _, _ in rows], key=lambda x: (x[0], x[1]))
    text = {i: (t or "").encode() for i, _, t in rows}
    for r in got:
        assert bytes(r.payload) == (b"" if r.kind == "revisit" else text[r.id])
        assert r.n_bytes == len(text[r.id]) and r.digest == hashlib.sha256(text[r.id]).hexdigest()


def test_archive_cut_short_is_an_error(spark):
    path = shared_scratch(spark, "cut")
    local = path.removeprefix("file://")
    df = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    warc.write(df, path)
    part = next(f for f in os.listdir(local) if f.startswith("part-"))
    with open(f"{local}/{part}", "rb") as f:
        data = f.read()
    other = shared_scratch(spark, "cut").removeprefix("file://")
    os.makedirs(other)
    with open(f"{other}/part-0.txt", "wb") as f:
        f.write(data[:-30])
    with pytest.raises(ValueError, match="archives"):
        warc.read(spark, f"file://{other}")
    assert len(data.split(b"WARC/1.0\r\n")) == 6


def test_archive_of_an_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string, payload long")).count() == 0


def test_pointer_jumping_reaches_the_chain_only(spark):
    links = [("a", i * 10, i * 10 + 10) for i in range(37)] + [("a", 5, 10), ("a", 15, 25), ("a", 25, 15), ("b", 0, 7), ("b", 9, 11)]
    df = spark.createDataFrame(links, "file string, offset long, next long")
    got = {(r.file, r.offset) for r in warc.reachable(df).collect()}
    assert got == {("a", i * 10) for i in range(37)} | {("b", 0)}


def texts(spark, pages):
    out = maintext.extract(spark.createDataFrame(pages, "page_id long, url string, html string"))
    return {(r.page_id, r.url): r.text for r in out.collect()}


def test_main_text_by_markup(spark):
    pages = [
        (1, "http://a.example", "<header>no</header><div class='cookie-notice'>no</div><article class='post'><h1>Title</h1><p>One<p>Two <!-- c --> three</p>"
         "<ul><li>a<li>b</ul><section id='comments'><article class=comment>no</article></section></article><div class='sidebar'>no</div>"),
        (2, "http://b.example", "<main><p>Hello &lt;b&gt; w&ouml;rld&nbsp; x<br>y</p><aside>no</aside><div class='comments'><p>no</p></div><form>no<input></form></main>"
         "<footer>no</footer><script>var t='<p>no</p>'</script><style>p{}</style>"),
        (3, None, None), (4, "http://c.example", ""), (5, "u", "just text &amp; no markup"), (6, "u", "<article><p>cut sho"),
    ]
    got = texts(spark, pages + pages[:1])
    assert got[(1, "http://a.example")] == "Title\n\nOne\n\nTwo three\n\na\n\nb"
    assert got[(2, "http://b.example")] == "Hello <b> wörld x y"
    assert got[(3, None)] == got[(4, "http://c.example")] == ""
    assert got[(5, "u")] == "just text & no markup" and got[(6, "u")] == "cut sho"


def test_main_text_by_host_suffix_array(spark):
    """Without main elements, what recurs on a host's pages goes; copies of a page stay."""
    menu = "<div>Home News Sport Weather Maps Mail Shop More and more</div>"
    note = "<p>Accept all of our cookies to go on reading this fine site today</p>"
    own = lambda i: "".join(f"<p>{' '.join(f'w{i}_{k}_{j}' for j in range(14))}</p>" for k in range(3))
    pages = [(i, f"http://a.example/{i}", f"<html>{menu}{own(i)}{note}</html>") for i in range(40)]
    pages += [(100, "http://b.example/0", f"<html>{menu}{own(0)}</html>"), (101, "http://a.example/0", pages[0][2])]
    got = texts(spark, pages)
    for i in range(1, 40):
        assert got[(i, f"http://a.example/{i}")] == "\n\n".join(" ".join(f"w{i}_{k}_{j}" for j in range(14)) for k in range(3))
    assert got[(0, "http://a.example/0")] == got[(101, "http://a.example/0")] and got[(0, "http://a.example/0")].startswith("w0_0_0")
    assert got[(100, "http://b.example/0")].startswith("Home News")  # another host


def test_main_text_equals_the_articles_of_the_table(spark):
    import html

    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r.page_id: r.text for r in maintext.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
    assert maintext.extract(pages.limit(0)).count() == 0


CALL = "conv long, call_id string, turn long, name string, arguments string, after array<string>"
PARAMETERS = [("f", "x", "integer", True), ("f", "y", "string", False), ("g", "z", "object", False), ("g", "n", "number", False), ("g", "x", "array", False)]


def linked(spark, calls, results, parameters=PARAMETERS):
    out = toolcalls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, "conv long, call_id string, turn long, content string"),
                         spark.createDataFrame(parameters, "name string, param string, type string, required boolean"))
    return {(r.conv, r.call_id): r for r in out.collect()}


def test_calls_meet_results_and_schemas(spark):
    calls = [(1, "a", 0, "f", '{"y": "q\\n", "x": 5}', None), (1, "b", 2, "g", '{"z":{"k2":1,"k1":[2, 3]},"n":2.5,"x":[]}', ["a"]), (1, "c", 4, "f", '{"x":"no","w":null}', ["zz"]),
             (2, "a", 0, "h", "{}", None), (2, "b", 0, "f", "not json", []), (2, "c", 1, "f", '{"x":1,"x":2}', None), (2, "d", 1, "f", None, None), (2, "e", 1, "f", "[1]", None),
             (3, "a", 0, "f", '{"x":1}', None), (3, "a", 0, "f", '{"x":1}', None), (3, "a", 1, "f", '{"x":2}', None), (None, "a", 0, "f", "{}", None), (3, None, 0, "f", "{}", None)]
    results = [(1, "a", 1, 'say "hi"'), (1, "a", 2, "again"), (1, "b", 3, None), (9, "a", 0, "lost"), (None, "a", 0, "x")]
    got = linked(spark, calls, results)
    assert len(got) == 10
    a = got[(1, "a")]
    assert (a.status, a.result, a.n_results, list(a.errors)) == ("linked", 'say "hi"', 2, [])
    assert a.message == '{"arguments":{"x":5,"y":"q\\n"},"id":"a","name":"f","result":"say \\"hi\\""}'
    assert json.loads(a.message)["arguments"] == {"x": 5, "y": "q\n"}
    assert got[(1, "b")].arguments == '{"n":2.5,"x":[],"z":{"k1":[2,3],"k2":1}}' and list(got[(1, "b")].errors) == []
    assert got[(1, "b")].message.endswith('"result":null}') and got[(1, "b")].n_results == 1
    assert list(got[(1, "c")].errors) == ["not integer: x", "unknown: w"]
    assert list(got[(2, "a")].errors) == ["function: unknown"]
    assert all(list(got[(2, k)].errors) == ["arguments: no JSON object"] for k in "bce")
    assert list(got[(2, "d")].errors) == ["missing: x"] and got[(2, "d")].arguments == "{}"
    assert got[(3, "a")].n_calls == 3 and got[(3, "a")].arguments == '{"x":1}'
    assert got[(9, "a")].status == "orphan_result" and got[(9, "a")].message is None


def test_order_respects_dependencies(spark):
    after = {"a": ["d"], "b": ["a"], "c": [], "d": [], "e": ["b", "c"], "f": ["e", "missing"], "p": ["q"], "q": ["p"], "r": ["q"]}
    turn = {k: i for i, k in enumerate(after)}
    calls = [(1, k, turn[k], "f", '{"x":1}', after[k]) for k in after] + [(2, "a", 0, "f", '{"x":1}', [])]
    got = linked(spark, calls, [])
    place = {k: (got[(1, k)].order_turn, got[(1, k)].order_step) for k in after}
    for k in "abcdef":
        for d in after[k]:
            assert d == "missing" or place[d] < place[k]
    assert place["c"] == (2, 0) and place["d"] == (3, 0)
    assert place["p"] == place["q"] == (None, None) and "after: cycle" in got[(1, "p")].errors


def test_no_calls_at_all(spark):
    assert linked(spark, [], []) == {}
    only = linked(spark, [], [(1, "a", 0, "x")])
    assert only[(1, "a")].status == "orphan_result"


@pytest.mark.parametrize("name", ["op2_warc", "op5_decontamination", "op8_substring_dedup", "op10_tool_calls"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from flowbin.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=str)
    got = QUERIES[name](spark, SF001)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == want


def test_tool_calls_run_no_python(spark):
    from flowbin.llm.queries import QUERIES

    plan = QUERIES["op10_tool_calls"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
