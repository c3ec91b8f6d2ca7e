"""One query per operator over its whole table, and SQL where it can express the result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.functions.storage import scratch
from fusewright.llm.alignment import align_documents
from fusewright.llm.chat_rotation import rotate_perspectives
from fusewright.llm.common import table
from fusewright.llm.decontamination import UNITS, find_leaks
from fusewright.llm.embedding_join import similar_embeddings
from fusewright.llm.line_dedup import dedup_lines
from fusewright.llm.packing import pack_documents
from fusewright.llm.periodic import periodic_runs, planted
from fusewright.llm.quality_rules import quality_verdicts
from fusewright.llm.repeats import remove_repeats
from fusewright.llm.sharding import shard_documents
from fusewright.llm.simhash import simhash_components
from fusewright.llm.url_filter import UrlRule, judge_urls
from fusewright.llm.warc import archive_pages

URL_RULES = [
    UrlRule("allow", "com"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]
N_SHARDS = 8


def op1_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_verdicts(table(spark, sf_dir, "documents")).select(*columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("row.doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.col("row.text").alias("text"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is ``bytes``: slots go to shards by the bytes they hold."""
    placed = shard_documents(table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_components(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_embedding_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_embeddings(table(spark, sf_dir, "embeddings"), 0.98)


def _digest(groups: Iterator[str]) -> str:
    """Of the groups of a document's pieces, joined by semicolons."""
    digest, lead = hashlib.sha256(), ""
    while part := list(islice(groups, 1 << 14)):
        digest.update((lead + ";".join(part)).encode())
        lead = ";"
    return digest.hexdigest()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), _digest)
    return aligned.select(F.col("doc_id").cast("long"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs of ``planted`` documents; the longest run's four columns are null where there is none."""
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # of equal lengths the first by start, then period
    ordered = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(ordered, F.lit(0))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), (-best["k"]).alias("length"), best["period"].alias("period"),
        F.floor(-best["k"] * 1000 / best["period"]).cast("long").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_config_lp_packing, op2_chat_rotation, op3_quality_rules, op4_line_dedup, op5_url_filter, op6_template_decontamination, op7_repeats, op8_virtual_slots, op9_simhash, op10_warc, op11_embedding_pigeonhole, op12_token_alignment, op13_periodic_runs)}

QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL = {
    "op2_chat_rotation": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations
), r AS (
  SELECT t.conv_id, p.participant, t.turn, t.speaker, t.text,
    CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = p.participant THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker NOT IN ('system', 'unknown')) p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), h AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
    '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || translate(replace(speaker, '<|im_', '< |im_'), chr(13) || chr(10), '  ') ELSE '' END || chr(10) AS header FROM r
), s AS (
  SELECT *, header || text || '<|im_end|>' || chr(10) AS segment FROM h
), w AS (
  SELECT *, row_number() OVER o - 1 AS position, CAST(sum(length(segment)) OVER o AS BIGINT) AS stop
  FROM s WINDOW o AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, participant, position, turn, role, name, segment, stop - length(segment) AS start, stop,
  CASE WHEN role = 'assistant' THEN stop - length(segment) + length(header) END AS mask_start,
  CASE WHEN role = 'assistant' THEN stop - 1 END AS mask_stop
FROM w""",
    "op3_quality_rules": r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2))) AS gram FROM d
), c AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g) WHERE k > 1
), p AS (
  SELECT doc_id, count(DISTINCT word) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS word FROM c) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN p ON d.doc_id = p.doc_id
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS v_word_length, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS v_symbols,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS v_dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS v_repeats FROM m
), s AS (
  SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket FROM (
    SELECT lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS measure, unnest([v_word_length, v_symbols, v_dup_lines, v_repeats]) AS v FROM v WHERE NOT base_failed)
), q AS (
  SELECT grouping(source) AS g_source, grouping(lang) AS g_lang, lang, source, measure, count(*) AS total,
    quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3
  FROM s GROUP BY GROUPING SETS ((lang, source, measure), (lang, measure), (measure))
), f AS (
  SELECT *, greatest(q3 - q1, CASE measure WHEN 'word_length' THEN 150 WHEN 'symbols' THEN 25 WHEN 'dup_lines' THEN 75 ELSE 70 END) AS spread FROM q
), l AS (
  SELECT o.lang, o.source, o.measure,
    CASE WHEN o.total >= 200 THEN o.q1 - 6 * o.spread WHEN b.total >= 200 THEN b.q1 - 6 * b.spread ELSE a.q1 - 6 * a.spread END AS low,
    CASE WHEN o.total >= 200 THEN o.q3 + 6 * o.spread WHEN b.total >= 200 THEN b.q3 + 6 * b.spread ELSE a.q3 + 6 * a.spread END AS high
  FROM f o JOIN f b ON b.g_source = 1 AND b.g_lang = 0 AND b.lang IS NOT DISTINCT FROM o.lang AND b.measure = o.measure
    JOIN f a ON a.g_lang = 1 AND a.measure = o.measure WHERE o.g_source = 0 AND o.g_lang = 0
), x AS (
  SELECT doc_id, bool_and(v BETWEEN low AND high) AS inside FROM (
    SELECT doc_id, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS measure, unnest([v_word_length, v_symbols, v_dup_lines, v_repeats]) AS v FROM v) u
  JOIN l ON u.lang IS NOT DISTINCT FROM l.lang AND u.source IS NOT DISTINCT FROM l.source AND u.measure = l.measure GROUP BY doc_id
)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept
FROM v LEFT JOIN x ON v.doc_id = x.doc_id""",
    "op5_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(verdict, host, path)
), m AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op6_template_decontamination": r"""
WITH raw AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(coalesce(text, ''), '\$?[0-9]+(?:[.,][0-9]+)*%?|[\p{L}\p{M}]+|[.!?\n]') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(coalesce(text, ''), '\$?[0-9]+(?:[.,][0-9]+)*%?|[\p{L}\p{M}]+|[.!?\n]') FROM benchmark WHERE item_id IS NOT NULL
), shaped AS (
  SELECT side, id, list_filter(list_transform(w, lambda x, i: struct_pack(value := x, ends := x IN ('.', '!', '?', chr(10)), number := regexp_matches(x, '^[$0-9]'),
      unit := i > 1 AND regexp_matches(w[i - 1], '^[$0-9]') AND lower(x) IN (UNIT_LIST), first := i = 1 OR w[i - 1] IN ('.', '!', '?', chr(10)),
      title := lower(x) <> x AND length(x) > 1 AND substr(x, 2) = lower(substr(x, 2)))), lambda t: NOT t.ends) AS t FROM raw
), typed AS (
  SELECT side, id, list_transform(t, lambda y: struct_pack(value := y.value, open := y.title AND y.first AND NOT y.unit AND NOT y.number,
      template := CASE WHEN y.number THEN '<number>' WHEN y.unit THEN '<unit>' WHEN y.title AND NOT y.first THEN '<name>' ELSE lower(y.value) END)) AS t FROM shaped
), widths AS (
  SELECT DISTINCT least(len(t), 8) AS w FROM typed WHERE side = 'b' AND len(t) > 0
), span AS (
  SELECT side, id, w, unnest(range(0, len(t) - w + 1)) AS p, unnest(list_transform(range(0, len(t) - w + 1), lambda p: t[p + 1:p + w])) AS s
  FROM typed JOIN widths ON side = 'd' OR w = least(len(t), 8)
), kinds AS (
  SELECT side, id, w, p, s, false AS supposed, list_transform(s, lambda y: y.template) AS k FROM span WHERE side = 'b'
  UNION ALL
  SELECT side, id, w, p, s, true, list_transform(s, lambda y: CASE WHEN y.open THEN '<name>' ELSE y.template END) FROM span WHERE side = 'd' OR len(list_filter(s, lambda y: y.open)) > 0
), win AS (
  SELECT side, id, w, p, supposed, CASE WHEN len(list_filter(k, lambda x: x NOT IN ('<number>', '<name>', '<unit>'))) = 0 THEN list_prepend('values', list_transform(s, lambda y: y.value)) ELSE k END AS g FROM kinds
), m AS (
  SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.p - b.p AS shift, b.p AS p, b.w, b.supposed FROM win d JOIN win b ON d.w = b.w AND d.g = b.g WHERE d.side = 'd' AND b.side = 'b'
), slots AS (
  SELECT side, id, unnest(range(0, len(t))) AS p, unnest(t) AS t FROM typed
), ways AS (
  SELECT *, supposed AS way FROM m UNION ALL SELECT *, true FROM m WHERE NOT supposed
), pairs AS (
  SELECT DISTINCT m.doc_id, m.item_id, m.shift, m.way, m.p, CASE WHEN b.t.open THEN '<name>' ELSE b.t.template END AS kind, b.t.value AS ours, d.t.value AS theirs
  FROM (SELECT DISTINCT doc_id, item_id, shift, way, unnest(range(p, p + w)) AS p FROM ways) m
  JOIN slots b ON b.side = 'b' AND b.id = m.item_id AND b.p = m.p AND (b.t.template IN ('<number>', '<name>', '<unit>') OR (b.t.open AND m.way))
  JOIN slots d ON d.side = 'd' AND d.id = m.doc_id AND d.p = m.p + m.shift
), clash AS (
  SELECT doc_id, item_id, shift, way, p FROM pairs JOIN (
    SELECT doc_id, item_id, shift, way, kind, ours FROM pairs GROUP BY ALL HAVING count(DISTINCT theirs) > 1) USING (doc_id, item_id, shift, way, kind, ours)
), gone AS (
  SELECT DISTINCT m.doc_id, m.item_id, m.shift, m.supposed, m.p FROM m
  JOIN clash c ON c.doc_id = m.doc_id AND c.item_id = m.item_id AND c.shift = m.shift AND c.way = m.supposed AND c.p BETWEEN m.p AND m.p + m.w - 1
  JOIN pairs x ON x.doc_id = m.doc_id AND x.item_id = m.item_id AND x.shift = m.shift AND x.way = m.supposed AND x.p BETWEEN m.p AND m.p + m.w - 1 AND x.ours <> x.theirs
), ok AS (
  SELECT doc_id, item_id, p, w FROM m WHERE NOT EXISTS (
    SELECT 1 FROM gone g WHERE g.doc_id = m.doc_id AND g.item_id = m.item_id AND g.shift = m.shift AND g.supposed = m.supposed AND g.p = m.p)
), covered AS (
  SELECT doc_id, item_id, count(DISTINCT p) AS matched_windows FROM ok GROUP BY ALL
), tokens AS (
  SELECT doc_id, item_id, count(DISTINCT x) AS covered_tokens FROM (SELECT doc_id, item_id, unnest(range(p, p + w)) AS x FROM ok) GROUP BY ALL
)
SELECT c.doc_id, c.item_id, CAST(matched_windows AS INT) AS matched_windows, CAST(covered_tokens AS INT) AS covered_tokens, CAST(len(t.t) AS INT) AS item_tokens
FROM covered c JOIN tokens k ON c.doc_id = k.doc_id AND c.item_id = k.item_id JOIN typed t ON t.side = 'b' AND t.id = c.item_id
WHERE covered_tokens >= 0.5 * len(t.t)""".replace("UNIT_LIST", ", ".join(f"'{u}'" for u in UNITS)),
    "op10_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p""",
    "op11_embedding_pigeonhole": """
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS k, vec_id, label, embedding, coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings
), e AS (
  SELECT k, vec_id, label, CASE WHEN ok THEN list_transform(embedding, lambda x: coalesce(CAST(x AS DOUBLE), 0)) END AS v FROM u
), l AS (
  SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v) WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) >= 0.98 * sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))
), reach(a, b) AS (
  SELECT k, k FROM e UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b
), c AS (
  SELECT r.a AS k, min(e.vec_id) AS component_id FROM reach r JOIN e ON e.k = r.b GROUP BY r.a
), n AS (
  SELECT a AS k, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id IS NOT DISTINCT FROM c.component_id AS kept FROM e JOIN c ON c.k = e.k LEFT JOIN n ON n.k = e.k""",
}
