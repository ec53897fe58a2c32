"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import bpe, decontaminate, html_text, minhash, pii, suffixes, telephony, toxicity, url_rules, warc
from quernstone.session import cut, table

def vocabulary() -> str:
    """The public vocabulary of the registered queries; any path that the executors can read will do."""
    import public_tokenizers  # only these queries need it

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, as the minimum cut labels its blocks. Null html gives the empty text."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the five rules on every url. Null urls and those without :// have empty host and path, and no rule."""
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item: a window within a fifth of its words in edits. Null texts leak nothing."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), free_ends=True)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text: those of the base patterns and those that the random field adds. Null texts have none."""
    return pii.spans(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of the text decoded from them. A null text is an empty one."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under four-word shingles at similarity 0.8. Texts without words are alone."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the bytes of repeated 200-byte strings. A null text is an empty one."""
    return suffixes.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from labels of rows that aren't held out. Empty texts are scored, too."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.trained(documents, table(spark, sf_dir, "labels")))


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as stored telephony audio, read back: digests of the bytes, features of the resampled PCM. A null text is an empty one."""
    return telephony.read_back(cut(telephony.store_texts(table(spark, sf_dir, "documents")), "media"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of stored archives, equal payloads as revisits, read back and resolved. A null payload is an empty one."""
    archives = warc.write(warc.deduplicate(table(spark, sf_dir, "pages")))
    return warc.resolve(cut(warc.heads(archives), "heads")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_url_filters": op2_url_filters,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_bpe": op5_bpe,
    "op6_minhash": op6_minhash,
    "op7_suffixes": op7_suffixes,
    "op8_toxicity": op8_toxicity,
    "op9_telephony": op9_telephony,
    "op10_warc": op10_warc,
}

URL_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n
  FROM pages),
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
fits AS (
  SELECT n, rule, rule_verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC) AS best
  FROM parts, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE best = 1) USING (n)
"""

#: All pairs that share a shingle, so for small tables only; distinct word sequences stand for their copies.
MINHASH_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
seqs AS (SELECT w, min(doc_id) AS id FROM d WHERE len(w) > 0 GROUP BY w),
sets AS (
  SELECT id, CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM seqs),
sizes AS (SELECT id, len(s) AS n FROM sets),
one AS (SELECT id, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.id AS a, b.id AS b, count(*) AS common FROM one a JOIN one b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT id, id FROM seqs UNION SELECT r.id, e.b FROM reach r JOIN ends e ON e.a = r.other),
least AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, d.doc_id = coalesce(l.component, d.doc_id) AS kept
FROM d LEFT JOIN seqs q ON q.w = d.w LEFT JOIN sizes z ON z.id = q.id LEFT JOIN least l ON l.id = q.id
"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY html) AS keep_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (substr(bits, CAST(5 * i + 1 AS INTEGER), 5)::BIT::INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep_id THEN NULL ELSE keep_id END AS refers_to
FROM d
"""

ORACLE_SQL: dict[str, str] = {"op2_url_filters": URL_SQL, "op6_minhash": MINHASH_SQL, "op10_warc": WARC_SQL}
