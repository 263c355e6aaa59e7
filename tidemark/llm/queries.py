"""The operators over their whole tables, with production parameters, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; the same place on every machine of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licence_scan import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_ledger import apply_policy, ledger

    out = apply_policy(ledger(table(spark, sf_dir, "documents")), "web-v1")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import tokenize_to_files

    return tokenize_to_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), added=True)


def op5_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm_substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), 13, ("doc_id", "n_words", "n_removed", "kept_sha256"))


def op6_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_join import line_counts

    out = line_counts(table(spark, sf_dir, "documents"), width=5, percent=80)
    return out.withColumn("kept_lines", F.concat_ws(",", F.col("kept_lines").cast("array<string>")))


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minmax_dedup import components

    return components(table(spark, sf_dir, "documents"), width=4, percent=80).drop("_h")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .histogram_sort import histogram_sort

    out = histogram_sort(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .stream_dedup import dedup_files

    out = dedup_files(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings")).drop("label")


SQL: dict[str, str] = {
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS all_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v) AS p, 1 + 1000000000::HUGEINT * (all_n + 5) // (all_total + 5 * v) AS q
      FROM t JOIN k ON k.lang = t.lang JOIN l ON l.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM e QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50""",
    "op11_stream_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op6_line_join": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS no, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
w AS (SELECT doc_id, no, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM l WHERE len(ws) > 0),
t AS (SELECT DISTINCT doc_id, no, array_to_string(ws[k:k + 4], ' ') AS tok FROM w),
s AS (SELECT doc_id, no, count(*) AS n FROM t GROUP BY ALL),
o AS (SELECT a.doc_id, a.no, b.doc_id AS d2, b.no AS n2, count(*) AS c FROM t a JOIN t b USING (tok)
      WHERE b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.no < a.no) GROUP BY ALL),
gone AS (SELECT DISTINCT o.doc_id, o.no FROM o JOIN s x ON x.doc_id = o.doc_id AND x.no = o.no JOIN s y ON y.doc_id = o.d2 AND y.no = o.n2
         WHERE 100 * c >= 80 * (x.n + y.n - c)),
k AS (SELECT s.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.no IS NOT NULL) AS n_removed,
        coalesce(string_agg(s.no::VARCHAR, ',' ORDER BY s.no) FILTER (WHERE g.no IS NULL), '') AS kept_lines
      FROM s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.no = s.no GROUP BY s.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_lines, '') AS kept_lines
FROM documents LEFT JOIN k USING (doc_id)""",
    "op2_rule_ledger": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM t)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, range(8) AS x(k) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        len(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
        len(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs
      FROM t LEFT JOIN cov USING (r)),
f AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words AND n_words > 0)::BIGINT
        + 8 * (n_lines > 0 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (n_words > 0 AND word_chars < 2 * n_words)::BIGINT
        + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (n_upper > 0 AND 100 * n_upper > 70 * (n_upper + n_lower) AND n_words > 0)::BIGINT
        + 128 * (n_words > 0 AND 2 * n_bangs > n_words)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) != 0 AS base_failed, (failed & 247) = 0 AS kept, failed FROM f""",
    "op3_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, w)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN it USING (r)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
