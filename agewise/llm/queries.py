"""The registered queries of this subpackage: thin wrappers that derive the agreed columns from the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agewise.llm.bpe import encode_decode
from agewise.llm.chat import CONTROLS, END, SEP, START, format_chats, log_of_turns, read_loss, read_turns
from agewise.llm.collocations import collocations
from agewise.llm.common import held_out, materialise, shared_dir, table
from agewise.llm.lines import dedup_lines
from agewise.llm.mixing import mix_sources, word_count
from agewise.llm.prefix_trie import prefix_trie
from agewise.llm.quality import document_statistics, fit_discriminant, score_statistics
from agewise.llm.repetition import repetition_rules
from agewise.llm.simhash import simhash_classes
from agewise.llm.toxicity import fit_toxicity, score_toxicity
from agewise.llm.urls import filter_urls
from agewise.llm.vectors import near_vectors
from agewise.llm.warc import read_bundles, write_bundles


#: The rows of each label that the toxicity classifier learns from at most.
SAMPLE = 2000


def known_labels(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(doc_id, label) of the labelled rows that a model may learn from."""
    labels = table(spark, sf_dir, "labels").where(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return labels.select("doc_id", F.col(label).alias("label"))


def _scored(found: DataFrame, threshold: float) -> DataFrame:
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = fit_discriminant(stats.join(known_labels(spark, sf_dir, "quality"), "doc_id"), stat_col="x")
    return _scored(score_statistics(stats, model), 0.7)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "epoch", word_count(F.col("text")).alias("n_tokens"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = shared_dir(spark, "warc")
    index = write_bundles(table(spark, sf_dir, "pages"), directory)
    if index.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")
    found = read_bundles(spark, directory, index)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = known_labels(spark, sf_dir, "toxic")
    share = labels.agg(F.avg("label")).first()[0]
    chosen = [labels.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(SAMPLE) for y in (0, 1)]
    # at most SAMPLE rows (id, label) of each label, so the texts need no shuffle
    sample = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    model = fit_toxicity(materialise(sample, "sample"), per_class=SAMPLE, toxic_share=share)
    return _scored(score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), model), 0.3)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition_rules(table(spark, sf_dir, "documents"))
    return found.drop("spans")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), grafted=True)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    found = format_chats(log_of_turns(turns))
    told, learnt = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("turns"))
    read = found.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), told.alias("told"), F.array_join(learnt, "").alias("learnt"))
    lines = F.array_join(F.transform("told", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("told").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


QUERIES = (
    op1_quality,
    op2_mixing,
    op3_url_filter,
    op4_warc,
    op5_byte_bpe,
    op6_vectors,
    op7_simhash,
    op8_toxicity,
    op9_line_dedup,
    op10_repetition,
    op11_prefix_trie,
    op12_collocations,
    op13_chat,
)

#: The escapes as plain replacements, and the sizes of the marks.
_ESCAPED = "replace({}, chr(92), chr(92) || chr(92))"
for _c in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"
_CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(START) + len(SEP) + len(END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES = {
    "op3_url_filter": r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, lower_ascii AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT *, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM pages)
),
outside AS (
  SELECT url, host, path, unnest(list_transform(string_split(html, '<!--'), lambda s, i: CASE WHEN i = 1 THEN s WHEN contains(s, '-->') THEN substr(s, strpos(s, '-->') + 3) ELSE '' END)) AS part
  FROM u WHERE host <> '' AND html <> ''
),
tags AS (
  SELECT url, host, path, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, split_part(tag, '>', 1) AS tag
  FROM (SELECT url, host, path, unnest(string_split(part, '<')[2:]) AS tag FROM outside)
),
named_by_tags AS (
  SELECT url, host, path, scheme, regexp_replace(CASE
    WHEN regexp_matches(tag, '(?i)^link[\x20\t\n\f\r]') AND regexp_matches(tag, '(?i)[\x20\t\n\f\r"''/]rel[\x20\t\n\f\r]*=[\x20\t\n\f\r]*["'']?canonical(["''/\x20\t\n\f\r]|\z)')
      THEN regexp_extract(tag, '(?i)[\x20\t\n\f\r"''/]href[\x20\t\n\f\r]*=[\x20\t\n\f\r]*["'']?([^"''\x20\t\n\f\r]+)', 1)
    WHEN regexp_matches(tag, '(?i)^meta[\x20\t\n\f\r]') AND regexp_matches(tag, '(?i)[\x20\t\n\f\r"''/]http-equiv[\x20\t\n\f\r]*=[\x20\t\n\f\r]*["'']?refresh(["''/\x20\t\n\f\r]|\z)')
      THEN regexp_extract(tag, '(?i)[\x20\t\n\f\r"''/]content[\x20\t\n\f\r]*=[\x20\t\n\f\r]*["''][^"'']*?url[\x20\t\n\f\r]*=[\x20\t\n\f\r]*([^"''\x20\t\n\f\r;]+)', 1)
    END, '(?i)&(amp|#38|#x26);', '&', 'g') AS x
  FROM tags
),
ends AS (
  SELECT url AS src, CASE WHEN regexp_matches(x, '(?i)^[a-z][a-z0-9+.-]*://') THEN x WHEN starts_with(x, '//') THEN scheme || ':' || x WHEN starts_with(x, '/') THEN scheme || '://' || host || x
         ELSE scheme || '://' || host || regexp_replace(path, '[^/]*$', '') || x END AS dst
  FROM named_by_tags WHERE x <> ''
),
every AS (SELECT url FROM u UNION SELECT dst FROM ends),
named AS (
  SELECT url, host, path, CASE WHEN host <> '' THEN host || path || regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1) END AS node
  FROM (SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM every)
),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM named
),
judged AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM ruled),
link AS (SELECT DISTINCT s.node AS a, d.node AS b FROM ends JOIN named s ON s.url = src JOIN named d ON d.url = dst WHERE s.node IS NOT NULL AND d.node IS NOT NULL AND s.node <> d.node),
pairs AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, a FROM pairs UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON l.a = r.b),
class AS (SELECT r.a AS node, bool_or(coalesce(j.verdict = 'allow', false)) AS ok, bool_or(coalesce(j.verdict = 'block', false)) AS bad FROM reach r JOIN judged j ON j.node = r.b GROUP BY 1)
SELECT u.page_id, u.host, u.path, j.rule, coalesce(j.verdict, CASE WHEN c.bad AND NOT c.ok THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN judged j ON j.url IS NOT DISTINCT FROM u.url LEFT JOIN class c ON c.node = j.node
""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to, true AS intact
FROM f
""",
    "op6_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS raw FROM embeddings),
good AS (SELECT vec_id, label, list_transform(raw, lambda x: coalesce(x, 0)) AS e FROM v WHERE label IS NOT NULL AND raw IS NOT NULL AND len(list_filter(raw, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(raw, lambda x: x * x)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links,
       (SELECT min(b) FROM reach WHERE reach.a = v.vec_id) AS component_id,
       v.vec_id = (SELECT min(b) FROM reach WHERE reach.a = v.vec_id) AS kept
FROM v
""",
    "op9_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
),
often AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often o ON lines.k = o.k
GROUP BY doc_id
""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, coalesce(role, '') AS role, turn,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
),
p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, digest) AS d, digest, words FROM t),
bits AS (SELECT c, list_transform(range(8 * length(c::VARCHAR)), lambda i: (ord(substr(c::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1) AS b FROM (SELECT DISTINCT c FROM t)),
ids AS (
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], b::BIGINT[]), lambda x, y: CASE WHEN xor(x, y) & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295::BIGINT) % 4 AS h
  FROM bits
),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, d) AS d, digest, words FROM (
    SELECT p.c, 1 AS part, d, digest, words FROM p JOIN ids USING (c) WHERE d > h
    UNION ALL SELECT ids.c, 0, d, digest, words FROM ids JOIN p ON p.c = ids.c - ids.c % 20 WHERE d <= h)
),
convs AS (SELECT ids.c, coalesce(list(digest ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS path, list(words ORDER BY d) AS words FROM ids LEFT JOIN rebuilt USING (c) GROUP BY 1),
each AS (SELECT c, len(path) AS n, unnest(range(len(path) + 1)) AS d, path, words FROM convs),
passed AS (SELECT c, d, n, sha256(array_to_string(path[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(path[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w, path FROM each),
nodes AS (
  SELECT k, d, up, any_value(w) AS w, min(c) AS low, count(*) AS n, any_value(path) AS path,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends
  FROM passed GROUP BY k, d, up
),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY 1),
sums AS (
  SELECT sha256(array_to_string(path[1:j], ',')) AS k, count(*) FILTER (WHERE leaf) AS leaves, sum((n - 1) * w) AS saved
  FROM (SELECT nodes.path, nodes.n, nodes.w, kids.n IS NULL AS leaf, unnest(range(d + 1)) AS j FROM nodes LEFT JOIN kids USING (k)) GROUP BY 1
)
SELECT a.low AS conv_id, a.d AS depth, b.low AS parent_conv_id, a.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM nodes a LEFT JOIN nodes b ON b.k = a.up LEFT JOIN kids ON kids.k = a.k JOIN sums ON sums.k = a.k
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT doc, lang, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS l FROM documents)
),
split AS (SELECT doc, i, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
sizes AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY 1),
grams AS (
  SELECT lang, m, array_to_string(ws[s:s + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM split, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m)
),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, array_to_string(ws[s:s + q - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, string_split(phrase, ' ') AS ws, a, q, unnest(range(1, m - q + 2)) AS s FROM f, (SELECT unnest([2, 3]) AS q) WHERE m > q) GROUP BY 1, 2
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, s.n, score
FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase JOIN sizes s ON s.lang = b.lang
WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * b.a
QUALIFY rank <= 2000
""",
    "op13_chat": _CHAT,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
