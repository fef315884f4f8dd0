"""One checked query per operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, chat, decontaminate, langid, lm, quality, ranking, repeats, reputation, rules, simhash, toxicity, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents sampled for their likeness to the labelled good ones."""
    return quality.select_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's side; the mask as text."""
    spans = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, ","))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, one row per document and item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels of the document that ends a page's path: bad if
    of no quality or toxic."""
    number = F.regexp_extract(reputation.host_and_path(F.col("url"))[1], r"/([0-9]+)(?:\.html)?/?$", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", number.try_cast("bigint").alias("_doc"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0
    )
    outcomes = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_id")).agg(F.max(bad).alias("bad"))
    pages = pages.join(outcomes, F.col("_doc") == F.col("_id"), "left")
    return reputation.judge(pages, F.col("bad"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents")).drop("spans")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer())


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that were given shared beginnings."""
    return trie.nodes_of(*trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_lm": op3_lm,
    "op4_chat": op4_chat,
    "op5_decontaminate": op5_decontaminate,
    "op6_reputation": op6_reputation,
    "op7_toxicity": op7_toxicity,
    "op8_rules": op8_rules,
    "op9_langid": op9_langid,
    "op10_bpe": op10_bpe,
    "op11_ranking": op11_ranking,
    "op12_repeats": op12_repeats,
    "op13_trie": op13_trie,
}

_CHAT_SQL = """
WITH said AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM said),
who AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
seen AS (
  SELECT r.conv_id, w.speaker, CAST((r.place - 1) // 256 AS INTEGER) AS part, r.place, r.role = w.speaker AS own,
    CASE WHEN r.role = 'system' THEN '<|system|>' WHEN r.role = w.speaker THEN '<|assistant|>'
      ELSE '<|user:' || replace(regexp_replace(r.role, '[\\r\\n]', ' ', 'g'), '|', '¦') || '|>' END || chr(10) || r.text || '<|end|>' || chr(10) AS segment
  FROM ranked r JOIN who w ON r.conv_id IS NOT DISTINCT FROM w.conv_id),
walked AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, speaker, part ORDER BY place) AS upto FROM seen)
SELECT conv_id, speaker, part, CAST(count(*) AS INTEGER) AS n_turns, string_agg(segment, '' ORDER BY place) AS text,
  coalesce(string_agg(CASE WHEN own THEN (upto - length(segment) + 14) || '-' || (upto - 1) END, ',' ORDER BY place), '') AS mask
FROM walked GROUP BY conv_id, speaker, part
"""

_SUFFIXES = ", ".join(f"'{s}'" for s in reputation.TWO_LABEL_SUFFIXES)

# One level: children t (n, k, prior key p) of parents u; strength by moments.
_STRENGTH_SQL = """
SELECT CASE WHEN free = 0 OR extra <= free THEN 1 / 0.001 - 1
  ELSE 1 / least(greatest((x - free) / (extra - free), 0.001), 0.999) - 1 END AS strength
FROM (SELECT sum(c.n * pow(c.k / c.n - m, 2) / (m * (1 - m))) AS x, sum(c.n - c.n * c.n / c.pn) AS extra,
        count(*) - count(DISTINCT c.up) AS free
      FROM (SELECT c.n::DOUBLE AS n, c.k::DOUBLE AS k, p.n::DOUBLE AS pn, c.{on} AS up, (p.k + 0.5) / (p.n + 1.0) AS m
            FROM {children} c JOIN {parents} p ON c.{on} = p.{on} WHERE c.n > 0) c)
"""


def _level_sql(name: str, children: str, parents: str, on: str) -> str:
    strength = _STRENGTH_SQL.format(children=children, parents=parents, on=on)
    return f"""{name} AS (
  SELECT c.*, s.strength + c.n AS total, (s.strength * p.mean + c.k) / (s.strength + c.n) AS mean
  FROM {children} c JOIN {parents}_mean p ON c.{on} = p.{on} CROSS JOIN ({strength}) s)"""


_REPUTATION_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
outcomes AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM labels GROUP BY doc_id),
known AS (
  SELECT host, bad FROM parts LEFT JOIN outcomes
    ON doc_id = try_cast(regexp_extract(path, '/([0-9]+)(?:\\.html)?/?$', 1) AS BIGINT)),
cut AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k,
    string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS l
  FROM known GROUP BY host),
ends AS (
  SELECT host, n, k, array_to_string(l[-1:], '.') AS one, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS two,
    array_to_string(l[greatest(len(l) - 2, 1):], '.') AS three FROM cut),
hosts AS (
  SELECT host, n, k, CASE WHEN two IN ({_SUFFIXES}) THEN two ELSE one END AS suffix,
    CASE WHEN two IN ({_SUFFIXES}) THEN three ELSE two END AS domain FROM ends),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, '' AS top, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
tops AS (SELECT '' AS top, sum(n) AS n, sum(k) AS k FROM suffixes),
tops_mean AS (SELECT *, (k + 1.0) / (n + 2.0) AS mean FROM tops),
{_level_sql("suffixes_mean", "suffixes", "tops", "top")},
{_level_sql("domains_mean", "domains", "suffixes", "suffix")},
{_level_sql("hosts_mean", "hosts", "domains", "domain")},
judged AS (
  SELECT page_id, p.host, path, mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) > 0.5 AS blocked,
    CASE WHEN (p.host = 'example.net' OR ends_with(p.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (p.host = 'org' OR ends_with(p.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts p JOIN hosts_mean h ON p.host = h.host)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR blocked THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_RANKING_SQL = r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS doc
  FROM documents),
totals AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM found),
held AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM found) GROUP BY doc, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held CROSS JOIN totals GROUP BY term, n_docs),
docs AS (SELECT doc, doc_id, 25 + (75 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM found CROSS JOIN totals WHERE len(terms) > 0),
items AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS item FROM benchmark))
  GROUP BY item, item_id, term),
scores AS (
  SELECT item, item_id, doc, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN held USING (term) JOIN docs USING (doc)
  GROUP BY item, item_id, doc, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_TRIE_SQL = """
WITH ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
counts AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))),
      4294967295::BIGINT) % 6 AS h
  FROM ranked GROUP BY conv_id),
convs AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS lent FROM counts c LEFT JOIN counts b ON b.conv_id = c.base),
turns AS (
  SELECT c.conv_id, r.place AS depth, role, text FROM convs c JOIN ranked r ON r.conv_id = c.base AND r.place <= c.h
  UNION ALL
  SELECT conv_id, lent + place - h, role, text FROM ranked JOIN convs USING (conv_id) WHERE place > h),
walked AS (
  SELECT conv_id, depth, length(text) AS size,
    md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node
  FROM turns UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
paths AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM walked),
nodes AS (
  SELECT node, max(parent) AS parent, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size
  FROM paths GROUP BY node),
families AS (SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, node, depth = max(depth) OVER (PARTITION BY conv_id) AS is_last FROM walked) WHERE is_last GROUP BY node),
totals AS (
  SELECT p.node, sum((x.n_convs - 1) * x.size)::BIGINT AS saved_tokens, count(*) FILTER (f.parent IS NULL) AS n_leaves
  FROM nodes x JOIN paths p ON p.conv_id = x.conv_id AND p.depth <= x.depth LEFT JOIN families f ON f.parent = x.node GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON up.node = n.parent LEFT JOIN families f ON f.parent = n.node JOIN totals t ON t.node = n.node LEFT JOIN ends e ON e.node = n.node
"""

# Learned models, fingerprints, merges and whole-text statistics have no SQL
# form; their tests compare with brute force or held-out rows.
ORACLES: dict[str, str] = {"op4_chat": _CHAT_SQL, "op6_reputation": _REPUTATION_SQL, "op11_ranking": _RANKING_SQL, "op13_trie": _TRIE_SQL}
