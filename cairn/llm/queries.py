"""The driver's queries over this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import ann, bpe, decontaminate, html, katz, langid, neardup, pii, secrets, tokenstore

Query = Callable[[SparkSession, str], DataFrame]


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_pii that SQL can express."""
    return pii.op3(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def katz_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_katz that SQL can express; they need no bigrams."""
    return katz.counts(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict[str, Query]:
    return {
        "op1_secrets": secrets.op1,
        "op2_nearest": ann.op2,
        "op3_pii": pii.op3,
        "op4_katz": katz.op4,
        "op5_main_text": html.op5,
        "op6_language_id": langid.op6,
        "op7_near_duplicates": neardup.op7,
        "op8_token_store": tokenstore.op8,
        "op9_decontaminate": decontaminate.op9,
        "op10_byte_bpe": bpe.op10,
        "pii_base_spans": pii_base_spans,
        "katz_counts": katz_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_nearest": _NEAREST, "op7_near_duplicates": _NEAR_DUPLICATES, "op9_decontaminate": _DECONTAMINATE, "pii_base_spans": _PII, "katz_counts": _KATZ}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: Exact; op2_nearest finds the same where its candidates are most of the rows, as on the driver's tables.
_NEAREST = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""

_NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {_SPACED} AS words FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 1 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
    SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) AS p
    JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON l.a = r.other
), components AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN components USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_BENCHMARK_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATE = f"""
WITH d AS (
    SELECT doc_id, {_BENCHMARK_WORDS} AS words FROM documents
), i AS (
    SELECT item_id::VARCHAR AS item, {_BENCHMARK_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item, least(len(words), 13) AS size, array_to_string(words[k:k + least(len(words), 13) - 1], ' ') AS gram
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS k FROM i WHERE len(words) > 0)
), grams AS (
    SELECT doc_id, k, size, array_to_string(words[k:k + size - 1], ' ') AS gram
    FROM (SELECT doc_id, words, size, unnest(range(1, greatest(len(words) - size + 2, 1))) AS k FROM d, (SELECT DISTINCT size FROM windows))
), found AS (
    SELECT doc_id, k, size, item FROM grams JOIN windows USING (size, gram)
), hit AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS word FROM found) GROUP BY 1
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
_BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(m, '{_OCTET}(?:\.{_OCTET}){{3}}')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN len({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 10 AND 15"),
]


def _found(k: int, kind: str, pattern: str, valid: str) -> str:
    """Matches alternate with the texts between them, so their lengths give positions."""
    pieces = f"SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM t"
    placed = f"SELECT doc_id, ms[i] AS m, (list_sum(list_transform(gs[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: len(g))), 0))::BIGINT AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({pieces}))"
    return f"SELECT doc_id, {k} AS k, '{kind}' AS kind, s, s + len(m) AS e FROM ({placed}) WHERE {valid}"


_PII = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_found(k, *x) for k, x in enumerate(_BASE))}),
counted AS (
    SELECT doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, (kind, *_) in enumerate(_BASE))}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS joined FROM spans GROUP BY 1
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in _BASE)}, sha256(coalesce(joined, '')) AS base_sha256 FROM t LEFT JOIN counted USING (doc_id)
"""

_KATZ = f"""
WITH crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS bytes
), d AS (
    SELECT doc_id, {_SPACED} AS words,
           coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)))::BIGINT[], lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 2, false) AS held_out
    FROM documents, crc_table
), tokens AS (
    SELECT doc_id, held_out, unnest(list_append(words, '</end of text>')) AS w FROM d
), trained AS (
    SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY 1
), totals AS (
    SELECT sum(c)::BIGINT AS n, count(*) AS v FROM trained
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM tokens LEFT JOIN trained USING (w), totals GROUP BY 1, 2
"""
