"""Registered queries of the corpus operators, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import bpe, collocations, exact_dedup, fingerprint, html_extract, langid, licenses, line_dedup, minhash, mixing, periodic_runs, quality, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql:
            CHECK_SQL[name] = sql
        return function

    return register


#: A-Z to lower case in DuckDB, whose lower() would change other letters too.
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


LOWER_KEY = ASCII_LOWER.replace("coalesce(text, '')", "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")


@query("op1_line_dedup", f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {LOWER_KEY} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
""")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(_table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_html_extract")
def op2_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = html_extract.extract(_table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op3_minhash", f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({ASCII_LOWER}, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_have >= 75 * (a.n + b.n - both_have)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
""")
def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


@query("op5_bpe")
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded_digests(_table(spark, folder, "documents"))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    # Whole texts are dealt, and the digests taken from what lies in the slots. The keys are digests too, so that no text goes twice.
    text = F.coalesce("text", F.lit(""))
    size, checksum = (F.octet_length(text) + 8).cast("long"), F.crc32(text)
    docs = _table(spark, folder, "documents").select("doc_id", "text", size.alias("_size"), checksum.alias("_crc"))
    dealt = sharding.shuffle_into_shards(docs, 24, ["doc_id", "_size", "_crc"])
    return dealt.select(
        "doc_id", size.alias("size"), checksum.alias("text_crc32"), "shard", "slot", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_exact_dedup", f"""
WITH d AS (SELECT doc_id, {ASCII_LOWER} AS t FROM documents),
n AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n
""")
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


@query("op8_langid")
def op8_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    planned = mixing.mix(_table(spark, folder, "documents"))
    return planned.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate",
    )


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.with_edits(_table(spark, folder, "documents"))


@query("op11_collocations", f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({ASCII_LOWER}, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM d),
m AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM w),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS p, count(*) AS n FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM m) GROUP BY ALL),
c AS (SELECT lang, m, p, n AS a, string_split(p, ' ') AS w FROM g WHERE m > 1 AND n >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.m, k.p, a, x.n AS l, y.n AS r, 2000000::HUGEINT * a // (x.n + y.n) AS score FROM k
    JOIN g x ON x.lang = k.lang AND x.p = array_to_string(k.w[1:k.k], ' ') JOIN g y ON y.lang = k.lang AND y.p = array_to_string(k.w[k.k + 1:], ' ')
    QUALIFY row_number() OVER (PARTITION BY k.lang, k.p ORDER BY 2000000::HUGEINT * a // (x.n + y.n), k.k) = 1),
j AS (SELECT lang, w, a, m, unnest(range(2, m)) AS j FROM c),
i AS (SELECT lang, w, a, j, unnest(range(1, m - j + 2)) AS i FROM j),
f AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS p, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT lang, p, a, l, r, score FROM s ANTI JOIN f ON s.lang = f.lang AND s.p = f.p AND 100 * longer >= 80 * a),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score::BIGINT AS score
FROM o JOIN t ON o.lang = t.lang QUALIFY rank <= 2000
""")
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return periodic_runs.digests(periodic_runs.find_runs(docs, "doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text"))))


@query("op13_quality")
def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
