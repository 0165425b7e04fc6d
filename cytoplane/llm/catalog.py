"""The numbered queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.llm import (
    contamination, divergence, fixity, language, line_dedup, packing, periodic, quality, secrets, simhash, substrings, topk, url_filter,
)

#: Fixed rules of the URL query, and addresses it lists as unwanted: (rule, verdict, priority).
RULES = [("net/", "block", 1), ("example.net/en/", "allow", 1), ("example.com/de/", "block", 1), ("org/fr/", "allow", 1)]
LISTED = [(f"{name}.example.{top}", "block", 0) for name in ("spam-farm", "cheap-pills", "casino-win") for top in ("com", "org")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    entries = spark.createDataFrame(RULES + LISTED, "rule string, verdict string, priority long")
    found = url_filter.filter_urls(table(spark, folder, "pages"), entries)
    mine = F.col("priority") == 1
    return found.select(
        "page_id", "host", "path", F.when(mine, F.col("rule")).alias("rule"), "verdict", F.when(~mine, F.col("rule")).alias("listed")
    )


_ENTRIES = ", ".join(f"('{r}', '{v}', {p})" for r, v, p in RULES + LISTED)
OP1_SQL = f"""
WITH entries(rule, verdict, priority) AS (VALUES {_ENTRIES}),
parts AS (
    SELECT *, CASE WHEN instr(rule, '/') > 0 THEN substr(rule, 1, instr(rule, '/') - 1) ELSE rule END AS rule_host,
        CASE WHEN instr(rule, '/') > 0 THEN substr(rule, instr(rule, '/')) ELSE '' END AS rule_path
    FROM entries),
urls AS (
    SELECT page_id, row_number() OVER () AS n,
        CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
            ELSE '' END AS path
    FROM pages),
best AS (
    SELECT n, arg_max(struct_pack(rule := rule, verdict := verdict, priority := priority), priority * 100000 + length(rule)) AS b
    FROM urls JOIN parts ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY n)
SELECT page_id, host, path, CASE WHEN b.priority = 1 THEN b.rule END AS rule, coalesce(b.verdict, 'allow') AS verdict,
    CASE WHEN b.priority = 0 THEN b.rule END AS listed
FROM urls LEFT JOIN best USING (n)
"""


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(~held_out())
    model = quality.train(documents, labels)
    found = quality.score_quality(documents, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "size_good", "size_bad", "size_plain")


def op3_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """The pages' archives against a replica written without some records (so later offsets shift) and with others altered."""
    pages = table(spark, folder, "pages")
    altered = F.when(F.col("page_id") % 97 == 3, F.translate("html", "e", "x")).otherwise(F.col("html"))
    replica = pages.withColumn("html", altered).where("page_id is null or page_id % 101 <> 7")
    found = fixity.audit(fixity.warc_records(pages), fixity.warc_records(replica))
    name = F.coalesce("record_id", "replica_record_id").alias("record_id")
    return found.select("archive", "offset", "kind", name, "digest", "replica_digest")


OP3_SQL = """
WITH bodies AS (
    SELECT page_id, concat(coalesce(CAST(page_id AS VARCHAR), ''), ' ', coalesce(url, ''), chr(10), coalesce(html, '')) AS body,
        concat(coalesce(CAST(page_id AS VARCHAR), ''), ' ', coalesce(url, ''), chr(10),
            CASE WHEN page_id % 97 = 3 THEN replace(coalesce(html, ''), 'e', 'x') ELSE coalesce(html, '') END) AS other
    FROM pages),
records AS (
    SELECT page_id, CAST(floor(page_id / 100.0) AS BIGINT) AS archive, sha256(body) AS digest, sha256(other) AS other_digest,
        CAST(coalesce(sum(strlen(body)) OVER (PARTITION BY floor(page_id / 100.0) ORDER BY page_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM bodies)
SELECT archive, "offset", CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'altered' END AS kind, page_id AS record_id,
    digest, CASE WHEN page_id % 101 <> 7 THEN other_digest END AS replica_digest
FROM records WHERE page_id % 101 = 7 OR digest <> other_digest
"""


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, folder, "documents"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_contamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(items, 256).alias("items_sha256"), "contaminated")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    network = secrets.train(documents)
    return secrets.find_secrets(documents, network=network).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = language.identify(documents, language.train(documents.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    codes = topk.sign_codes(table(spark, folder, "embeddings"))
    return topk.top_k(codes, codes.where("vec_id % 50 = 0"), k=10)


OP10_SQL = """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS bits FROM embeddings),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: CAST(p[1] <> p[2] AS INTEGER))) AS INTEGER) AS distance
    FROM codes q, codes c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, vec_id, distance, rank FROM ranked WHERE rank <= 10
"""


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


_CASES = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP11_SQL = f"""
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), {_CASES}), '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS terms, row_number() OVER () AS n
    FROM documents),
words AS (SELECT lang, source, n, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
lang_counts AS (SELECT lang, term, sum(c) AS c FROM counts GROUP BY lang, term),
lang_totals AS (SELECT lang, sum(c) AS n FROM lang_counts GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v) AS p
    FROM totals g JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lang_shares AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v) AS q FROM lang_counts JOIN lang_totals USING (lang) JOIN langs USING (lang)),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares JOIN lang_shares USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    kept = line_dedup.kept_lines(documents, line_dedup.keep_bitmaps(documents))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS n, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, n, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_CASES}) AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT n) >= 10),
marked AS (SELECT keyed.*, often.key IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.key = often.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY n
"""


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents (by crc32 of the id) the words from place a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def planted(word):
        n = F.size(word)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(word, place(i))), " ")).otherwise("")

    chosen = F.pmod(h, F.lit(10)) == 0
    return documents.select("doc_id", F.when(chosen, F.transform(F.array(words), planted)[0]).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_periods(table(spark, folder, "documents")), texts=False)
    better = lambda a, b: (  # noqa: E731  greatest length / period, then smallest start, then smallest period
        F.when(a["length"] * b["period"] != b["length"] * a["period"], a["length"] * b["period"] > b["length"] * a["period"])
        .when(a["start"] != b["start"], a["start"] < b["start"]).otherwise(a["period"] <= b["period"])
    )
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), a).otherwise(b))
    by_start = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"], r["period"], r["length"])))
    listed = F.transform(by_start, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_quality, op3_fixity, op4_packing, op5_simhash, op6_substrings, op7_contamination, op8_secrets, op9_language, op10_topk,
        op11_divergence, op12_line_dedup, op13_periodic,
    )
}
ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op3_fixity": OP3_SQL, "op10_topk": OP10_SQL, "op11_divergence": OP11_SQL, "op12_line_dedup": OP12_SQL}
