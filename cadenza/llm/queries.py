"""The registered queries of the text operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.alignment import align_tokenizers
from cadenza.llm.chat import digest, expand_prefix_targets
from cadenza.llm.common import table
from cadenza.llm.decontaminate import contamination_digest, find_contamination
from cadenza.llm.divergence import divergence
from cadenza.llm.html_extract import extract_text
from cadenza.llm.line_dedup import dedup_lines
from cadenza.llm.packing import pack
from cadenza.llm.probminhash import near_duplicates
from cadenza.llm.quality_model import score_quality
from cadenza.llm.quality_rules import repetition_rules
from cadenza.llm.substring_dedup import remove_repeated
from cadenza.llm.toxicity import score_toxicity
from cadenza.llm.urls import judge_urls

#: Fixed extra conversation of the chat query.
SAMPLE_TEXT = "\\### Assistant: </turn> ok"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, which every machine of the cluster has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role").selectExpr("*", f"r'{SAMPLE_TEXT}' as text")
    return digest(expand_prefix_targets(turns.unionByName(extra)))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(find_contamination(docs, table(spark, sf_dir, "benchmark")))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents")).drop("line_share", "ngram_shares")


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat_formatting,
    "op2_decontamination": decontamination,
    "op3_substring_dedup": substring_dedup,
    "op4_html_extraction": html_extraction,
    "op5_near_dedup": near_dedup,
    "op6_quality_rules": quality_rules,
    "op7_packing": packing,
    "op8_url_filters": url_filters,
    "op9_line_dedup": line_dedup,
    "op10_quality_classifier": quality_classifier,
    "op11_toxicity": toxicity,
    "op12_source_divergence": source_divergence,
    "op13_tokenizer_alignment": tokenizer_alignment,
}

_ESCAPED = r"replace(replace(replace({0}, '\', '\s'), '</turn>', '\e'), '### ', '\h')"

_CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAMPLE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{SAMPLE_TEXT}'
), sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(14 + length(replace({_ESCAPED.format("role")}, ':', '\c')) + length({_ESCAPED.format("text")})) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_HOST = "translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_NODE = f"{_HOST} || regexp_extract(coalesce({{0}}, ''), '(?s)^.*?://[^/?#]*([^#]*)', 1)"
_RULE = """CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END"""
_SAID = "CASE WHEN {0} IN ('net/', 'example.com/de/') THEN 'block' WHEN {0} IS NOT NULL THEN 'allow' END"

#: A path without its segments . and .. (a .. at the top goes), where it has any.
_DOTTED = """CASE WHEN regexp_matches({0}, '/\\.\\.?(/|$)') THEN (
  WITH kept AS (SELECT list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(string_split({0}, '/')[2:], lambda p: [p])),
    lambda done, p: CASE p[1] WHEN '.' THEN done WHEN '..' THEN done[:greatest(len(done) - 1, 0)] ELSE list_concat(done, p) END) AS k)
  SELECT '/' || array_to_string(k, '/') || CASE WHEN string_split({0}, '/')[-1] IN ('.', '..') AND len(k) > 0 THEN '/' ELSE '' END FROM kept
) ELSE {0} END"""

_URL_SQL = rf"""
WITH RECURSIVE tags AS (
  SELECT DISTINCT url AS source, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<(?:link|meta)\b[^<>]*>'), lambda t: regexp_matches(t, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical["''\s>/]')), lambda t:
      regexp_extract(t, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) || regexp_extract(t, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(t, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<(?:link|meta)\b[^<>]*>'), lambda t: regexp_matches(t, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh["''\s>/]')), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1))
  )) AS t
  FROM pages WHERE html IS NOT NULL
), named AS (
  SELECT source, replace(trim(t, ' '), '&amp;', '&') AS t, split_part(source, '://', 1) AS scheme, split_part(source, '://', 1) || '://' || {_HOST.format("source")} AS site,
    CASE WHEN {_PATH.format("source")} = '' THEN '/' ELSE {_PATH.format("source")} END AS own
  FROM tags
), parts AS (
  SELECT *, regexp_extract(t, '(?s)^([^?#]*)', 1) AS path, regexp_extract(own, '(?s)^(.*/)', 1) || regexp_extract(t, '(?s)^([^?#]*)', 1) AS beside, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS rest
  FROM named WHERE contains(source, '://') OR contains(t, '://')
), edges AS (
  SELECT source, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN t = '' OR t LIKE '#%' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN t LIKE '//%' THEN scheme || ':' || t
    WHEN t LIKE '?%' THEN site || own || t
    WHEN t LIKE '/%' THEN site || {_DOTTED.format("path")} || rest
    ELSE site || {_DOTTED.format("beside")} || rest END AS target
  FROM parts
), good AS (SELECT * FROM edges WHERE {_HOST.format("source")} <> '' AND {_HOST.format("target")} <> ''),
ends AS (SELECT source AS u FROM edges WHERE target IS NOT NULL AND {_HOST.format("source")} <> '' UNION SELECT target FROM edges WHERE {_HOST.format("target")} <> ''),
nodes AS (SELECT DISTINCT node, {_SAID.format("rule")} AS said FROM (SELECT node, {_RULE} AS rule FROM (SELECT {_NODE.format("u")} AS node, {_HOST.format("u")} AS host, {_PATH.format("u")} AS path FROM ends))),
links AS (SELECT {_NODE.format("source")} AS a, {_NODE.format("target")} AS b FROM good UNION SELECT {_NODE.format("target")}, {_NODE.format("source")} FROM good),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
inherited AS (
  SELECT reach.node, CASE WHEN bool_or(said = 'allow') THEN 'allow' WHEN bool_or(said = 'block') THEN 'block' END AS v
  FROM reach JOIN nodes ON nodes.node = reach.other GROUP BY reach.node
), judged AS (
  SELECT page_id, CASE WHEN {_HOST.format("url")} <> '' THEN {_NODE.format("url")} END AS node, host, path, {_RULE} AS rule
  FROM (SELECT page_id, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages)
)
SELECT page_id, host, path, rule, coalesce({_SAID.format("rule")}, v, 'allow') AS verdict FROM judged LEFT JOIN inherited USING (node)
"""

_SHARE = "CAST(1 + 1000000000::HUGEINT * ({0} + 2) // ({1} + 2 * {2}) AS BIGINT)"
_GAP = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"

_DIVERGENCE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), held AS (SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM held GROUP BY ALL HAVING count(*) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL),
cells AS (SELECT lang, source, term, sum(held.n)::HUGEINT AS n FROM held SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0)::HUGEINT AS v, coalesce((SELECT sum(n) FROM cells WHERE cells.lang = g.lang AND cells.source = g.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)
), whole AS (
  SELECT lang, g.source, term, coalesce(c.n, 0) AS n, {_SHARE.format("coalesce(c.n, 0)", "g.total", "g.v")} AS p, kept.n AS in_lang
  FROM groups g JOIN kept USING (lang) LEFT JOIN cells c USING (lang, source, term)
), above AS (
  SELECT lang, source, term, p, {_SHARE.format("in_lang", "langs.total", "langs.v")} AS q FROM whole JOIN langs USING (lang) WHERE n > 0
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, {_GAP.format("p", "q")} AS value FROM above WHERE p > q
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum({_GAP.format("a.p", "b.p")})::BIGINT AS value FROM whole a JOIN whole b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs) QUALIFY part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {"op1_chat_formatting": _CHAT_SQL, "op8_url_filters": _URL_SQL, "op12_source_divergence": _DIVERGENCE_SQL}
