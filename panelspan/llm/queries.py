"""The registered queries of the training-data operators: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, line_dedup, minhash, quality, sentencepieces, simhash, substrings, token_counts, warc
from .scratch import folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(_table(spark, sf_dir, "documents"), budget=2048)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    warc.write(warc.with_revisits(_table(spark, sf_dir, "pages")), path)
    found = warc.read(spark, path, columns=["record_id", "record_type", "refers_to_id", "payload_digest", "payload_bytes"])
    return found.select(
        warc.page_id_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id_of(F.col("refers_to_id")).alias("refers_to"),
    )


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.compare_with_next(_table(spark, sf_dir, "documents"))
    prints = [F.lower(F.hex(c)).alias(n) for c, n in (("print", "fingerprint"), ("edited_print", "edited_fingerprint"))]
    return found.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), "line", "unit", "place")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.encode(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip")


QUERIES = {
    "op3_license_scan": op3_license_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op10_line_dedup": op10_line_dedup,
    "op1_warc": op1_warc,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_counts": op5_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op6_simhash_near_duplicates": op6_simhash_near_duplicates,
}


def _license_sql() -> str:
    rows = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate((n, t.replace("'", "''")) for n, t in licenses.TEMPLATES))
    words = r"string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
        WITH t AS (SELECT template, license, {words.format('body')} AS w FROM (VALUES {rows}) v(template, license, body)),
        tb AS (SELECT DISTINCT template, license, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
        ts AS (SELECT template, count(*) AS size FROM tb GROUP BY template),
        d0 AS (SELECT doc_id, text, contains(text, chr(10)) AS several, string_split_regex(text, '{licenses.PARAGRAPH}') AS ps, string_split(text, chr(10)) AS ls, string_split_regex(text, '{licenses.SENTENCE}') AS ss FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, 0 AS kind, 0 AS place, text AS unit FROM d0 WHERE several
            UNION ALL SELECT doc_id, 1, unnest(range(1, len(ls) + 1)), unnest(ls) FROM d0
            UNION ALL SELECT * FROM (SELECT doc_id, 2, unnest(range(1, len(ps) + 1)), unnest(ps) AS p FROM d0 WHERE several) WHERE contains(p, chr(10))
            UNION ALL SELECT doc_id, 3, unnest(range(1, len(ss) + 1)), unnest(ss) FROM d0 WHERE len(ss) > 1),
        uw AS (SELECT doc_id, kind, place, {words.format('unit')} AS w FROM u),
        ub AS (SELECT DISTINCT doc_id, kind, place, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT *, unnest(range(1, len(w))) AS i FROM uw)),
        us AS (SELECT doc_id, kind, place, count(*) AS n FROM ub GROUP BY doc_id, kind, place),
        m AS (SELECT ub.doc_id, ub.kind, ub.place, tb.template, tb.license, count(*) AS both_have FROM ub JOIN tb USING (bigram) GROUP BY ALL),
        d AS (SELECT m.*, 2.0::DOUBLE * both_have / (n + size) AS dice FROM m JOIN us USING (doc_id, kind, place) JOIN ts USING (template)),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, kind, place, template) AS k FROM d WHERE dice >= 0.8 - 1e-12)
        SELECT documents.doc_id, license, round(dice, 6) AS dice, CASE WHEN kind < 2 THEN CAST(place AS BIGINT) END AS line, {licenses.KINDS}[kind + 1] AS unit, CAST(place AS BIGINT) AS place
        FROM documents LEFT JOIN (SELECT * FROM b WHERE k = 1) b ON documents.doc_id = b.doc_id"""


_REPEATS_SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
    least_id AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, j FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN least_id USING (h) WHERE m < win.doc_id)),
    t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
    k AS (SELECT t.doc_id, count(*) AS n_words, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY t.j) FILTER (WHERE gone.j IS NULL) AS kept
        FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.j = gone.j GROUP BY t.doc_id)
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""

_LEAKS_SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS key FROM (SELECT *, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT n FROM iw),
    dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS key FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
    hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.key = iw.key AND dw.n = iw.n),
    words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_substring_dedup": _REPEATS_SQL,
    "op3_license_scan": _license_sql(),
    "op7_benchmark_decontamination": _LEAKS_SQL,
    "op1_warc": """
        WITH p AS (SELECT page_id, CAST(coalesce(strlen(html), 0) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        k AS (SELECT d, n, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d, n)
        SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest,
            CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN keeper <> page_id THEN keeper END AS refers_to
        FROM p LEFT JOIN k ON p.d = k.d AND p.n = k.n""",
}
