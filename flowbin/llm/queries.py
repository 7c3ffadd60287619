"""The registered queries of the operators; ORACLES has DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbin.llm import (
    centroids, decontam, fertility, langid, linecrf, maintext, orderminhash, pieces, sortedpasses, substrings, texttries, toolcalls, warc,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    found = orderminhash.classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back; payload columns from the bytes read."""
    back = warc.archive(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    revisit = F.col("kind") == "revisit"
    return back.select(F.col("id").alias("page_id"), F.when(revisit, F.col("n_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
                       F.when(revisit, F.col("digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, tokeniser measures and verdict of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = fertility.judge(docs, keep_text=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *fertility.MEASURES)
    return out.select("doc_id", *[F.col(f"fertility.{c}").alias(c) for c in names])


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = maintext.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of benchmark items in the documents."""
    out = decontam.find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("leaks.items", lambda i: i.cast("string")))
    return out.select("doc_id", F.col("leaks.n_words").alias("n_words"), F.col("leaks.n_hit").alias("n_hit"),
                      F.size("leaks.items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                      (F.col("leaks.n_hit") > 0).alias("contaminated"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; taught by the documents outside the held-out quarter."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    protos = langid.learn(docs.where(langid.bucket("doc_id", 4) != 2))
    out = langid.predict(docs.select("doc_id", "text"), protos)
    held = F.coalesce(langid.bucket("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, their count, hash and score, and whether they decode to it."""
    out = pieces.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    whole = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("pieces.ids").alias("ids"), F.size("pieces.ids").cast("long").alias("n_pieces"), F.xxhash64("pieces.ids").alias("ids_hash"),
                      F.col("pieces.score").alias("score"), (F.col("pieces.decoded") == whole).alias("round_trip"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a smaller document also has, removed from all documents."""
    out = substrings.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("repeats.n_words").alias("n_words"), F.col("repeats.n_removed").alias("n_removed"),
                      substrings.word_digest(F.col("text")).alias("kept_sha256"))


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; taught by the labels outside the held-out third."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(langid.bucket("doc_id", 3) != 1)
    out = linecrf.score(docs, linecrf.learn(docs, labels))
    held = F.coalesce(langid.bucket("doc_id", 3) == 1, F.lit(False))
    good = (F.col("quality_score") >= 0.5).cast("int")
    return out.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), good.alias("predicted"))


PARAMETERS = [("open", "query", "string", True), ("open", "turn", "integer", True), ("open", "words", "integer", False),
              ("continue", "query", "string", True), ("continue", "turn", "integer", True), ("continue", "words", "integer", True)]


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool use: a user turn calls, the assistant turn after it is the result.

    A call opens the conversation in its first two turns and continues it later, then it
    depends on the call two turns before.  Empty words are not passed, so that such calls of
    ``continue`` are invalid.
    """
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    # the arguments of a call, keys in no particular order
    arguments = F.to_json(F.struct("turn", F.col("text").alias("query"), F.when(words > 3, words).alias("words")))
    later = F.col("turn") >= 2
    calls = turns.where("role = 'user'").select(
        F.col("conv_id").alias("conv"), name(F.col("turn")).alias("call_id"), "turn", F.when(later, "continue").otherwise("open").alias("name"),
        arguments.alias("arguments"), F.when(later, F.array(name(F.col("turn") - 2))).alias("after"))
    results = turns.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    schema = "name string, param string, type string, required boolean"
    out = toolcalls.link(calls, results, spark.createDataFrame(PARAMETERS, schema))
    return out.withColumnRenamed("conv", "conv_id").withColumn("errors", F.array_join("errors", "; "))


def op11_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector to near ones of its label, and the least id that they reach."""
    out = sortedpasses.link_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "links.n_links", "links.component_id", "links.kept")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds in integers."""
    out = centroids.cluster_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "clustering.*")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by language."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return texttries.audit(docs, _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_warc": op2_warc,
    "op3_tokeniser_fertility": op3_tokeniser_fertility,
    "op4_main_text": op4_main_text,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_crf": op9_line_crf,
    "op10_tool_calls": op10_tool_calls,
    "op11_sorted_passes": op11_sorted_passes,
    "op12_centroids": op12_centroids,
    "op13_filter_audit": op13_filter_audit,
}


def _centroid_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds, a common table for each assignment and each set of centroids."""
    fine = "len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
                 FROM embeddings, unnest(generate_series(1, 64)) AS t(i) WHERE {fine})""",
             f"""c0 AS MATERIALIZED (SELECT rank - 1 AS c, i, x FROM v JOIN (
                 SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) AS rank FROM (SELECT DISTINCT vec_id FROM v)) USING (vec_id) WHERE rank <= {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, CAST(min(d * {k} + c) AS BIGINT) AS m FROM (
            SELECT vec_id, c, sum((v.x - w.x) * (v.x - w.x)) AS d FROM v JOIN c{r} AS w USING (i) GROUP BY vec_id, c) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(u.x, o.x) AS x FROM c{r} AS o LEFT JOIN (
                SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
                    SELECT m % {k} AS c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY ALL)) AS u ON o.c = u.c AND o.i = u.i)""")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, m // {k} AS distance, CAST(sum(m // {k}) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN h ON m % {k} = c"""

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d""",
    "op5_decontamination": r"""
        WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
                   FROM benchmark WHERE text IS NOT NULL),
        d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
        size AS (SELECT DISTINCT least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS s
               FROM (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0), unnest(generate_series(1, len(ws) - n + 1)) AS t(i)),
        dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS s FROM d, size, unnest(generate_series(1, len(ws) - n + 1)) AS t(i) WHERE len(ws) >= n),
        hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
        word AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(generate_series(0, n - 1)) AS t(k) GROUP BY doc_id),
        item AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
                 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s FROM d, unnest(generate_series(1, len(ws) - 12)) AS t(i) WHERE len(ws) >= 13),
        least_of AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN least_of USING (s), unnest(generate_series(0, 12)) AS t(k) WHERE first < doc_id),
        word AS (SELECT doc_id, i, ws[i] AS w FROM d, unnest(generate_series(1, len(ws))) AS t(i)),
        kept AS (SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS text, count(gone.i) AS n
                 FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op10_tool_calls": """
        WITH t AS (SELECT conv_id, turn, role, text, len(list_filter(string_split(text, ' '), lambda w: w != '')) AS n FROM conversations),
        c AS (SELECT conv_id, 'call_' || conv_id || '_' || turn AS call_id, min(turn) AS turn, CASE WHEN turn >= 2 THEN 'continue' ELSE 'open' END AS name,
                     min(text) AS text, arg_min(n, text) AS n, count(*) AS n_calls
              FROM t WHERE role = 'user' GROUP BY conv_id, turn),
        r AS (SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, min(text) AS result, count(*) AS n_results
              FROM t WHERE role = 'assistant' GROUP BY conv_id, turn),
        a AS (SELECT c.*, '{"query":' || to_json(text) || ',"turn":' || turn || CASE WHEN n > 3 THEN ',"words":' || n ELSE '' END || '}' AS arguments FROM c)
        SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, coalesce(a.call_id, r.call_id) AS call_id,
               CASE WHEN a.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
               name, arguments, CASE WHEN a.call_id IS NOT NULL THEN CASE WHEN name = 'continue' AND n <= 3 THEN 'missing: words' ELSE '' END END AS errors,
               turn AS order_turn, CASE WHEN a.call_id IS NOT NULL THEN CAST(0 AS BIGINT) END AS order_step, result,
               coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
               CASE WHEN a.call_id IS NOT NULL THEN '{"arguments":' || arguments || ',"id":"' || a.call_id || '","name":"' || name || '","result":' ||
                    coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' END AS message
        FROM a FULL JOIN r ON a.conv_id = r.conv_id AND a.call_id = r.call_id""",
    "op11_sorted_passes": """
        WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        u AS (SELECT * FROM e WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x != 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.v) = len(b.v)
              WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
        FROM e LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a""",
    "op12_centroids": _centroid_sql(),
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
                     + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
                     + 16 * CAST(doc_id > first AS INT) AS mask FROM w LEFT JOIN l USING (doc_id)),
        cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
              WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, CAST(step AS INT) AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
                     coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0)::INT AS before
              FROM o, unnest(generate_series(1, 5)) AS t(step)),
        r AS (SELECT part, filter_order, step, bit,
                     coalesce(sum(n) FILTER (mask & bit = 0 AND mask & before = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
                     coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
                     coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
              FROM cell, s GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
}
