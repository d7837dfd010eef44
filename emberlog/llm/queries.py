"""The operators as registered queries, and DuckDB twins where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import (
    decontam, divergence, license, lines, minhash, packing, prefixes, quality, sharding, simhash, substrings, toxicity, urls,
)
from emberlog.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.line_report(table(spark, sf_dir, "documents"))
    return rows.withColumn("kept_lines", F.array_join("kept_lines", ","))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_license_scan, op3_url_filter, op4_sharding, op5_packing, op6_suffix_dedup, op7_simhash_dedup,
        op8_line_dedup, op9_quality_rules, op10_decontamination,
        op11_minhash_dedup, op12_conversation_trie, op13_source_divergence,
    )
}

SQL: dict[str, str] = {
    # on the words themselves, without hashes and without the sieve
    "op8_line_dedup": r"""WITH l AS (SELECT doc_id, unnest(range(len(s)))::INTEGER AS n, unnest(s) AS raw
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
lines AS (SELECT doc_id, n, ws, len(ws) AS k, array_to_string(ws, ' ') AS line
  FROM (SELECT doc_id, n, list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l) WHERE len(ws) > 0),
c AS (SELECT line, any_value(ws) AS ws, any_value(k) AS k, min({'doc_id': doc_id, 'n': n}) AS pos FROM lines GROUP BY line),
v AS (SELECT line, k, pos, i, array_to_string(list_concat(ws[:i], ws[i + 2:]), ' ') AS rest
  FROM (SELECT *, unnest(range(k)) AS i FROM c WHERE k >= 5)),
first AS (SELECT rest, i, k, min(pos) AS p FROM v GROUP BY ALL),
gone AS (SELECT v.line FROM v JOIN first USING (rest, i, k) WHERE p < v.pos
  UNION SELECT v.line FROM v JOIN c ON v.rest = c.line WHERE c.k >= 5 AND c.pos < v.pos
  UNION SELECT c.line FROM v JOIN c ON v.rest = c.line WHERE c.k >= 5 AND v.pos < c.pos),
kept AS (SELECT pos.doc_id AS doc_id, count(*) AS m, string_agg(pos.n::VARCHAR, ',' ORDER BY pos.n) AS kept
  FROM c WHERE line NOT IN (SELECT line FROM gone) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1)
SELECT doc_id, coalesce(t.n, 0) AS n_lines, coalesce(t.n, 0) - coalesce(m, 0) AS n_removed, coalesce(kept, '') AS kept_lines
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    # all pairs of documents that share a shingle, and what they reach
    "op11_minhash_dedup": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(1, len(ws) - 2)), lambda i: array_to_string(ws[i + 1:i + 3], ' '))) AS shingle
  FROM d WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
linked AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b USING (shingle)
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT DISTINCT a, a AS b FROM linked UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, doc_id) AS component_id, coalesce(c.component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    # every path as a list of its turns
    "op12_conversation_trie": r"""WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, b: list_reduce(list_concat([xor(x, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
seqs AS (SELECT o.conv_id, list_concat(coalesce(f.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
  FROM own AS o LEFT JOIN own AS f ON f.conv_id = o.conv_id - o.conv_id % 20),
paths AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM seqs)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM paths GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
tree AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sums AS (SELECT path[1:k] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM tree) GROUP BY 1)
SELECT t.conv_id, t.d AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, t.ends_sha256
FROM tree AS t JOIN sums AS s USING (path) LEFT JOIN nodes AS p ON t.d > 0 AND p.path = t.path[1:t.d - 1]""",
    "op13_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
w AS (SELECT lang, source, k, unnest(ws) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
g AS (SELECT lang, source, sum(n) FILTER (kept.term IS NOT NULL) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN (SELECT lang, term FROM kept) AS kept USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(g.n, 0) + 5 * l.v) AS p,
    1 + 1000000000::HUGEINT * (kept.n + 5) // (l.n + 5 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM l)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
}
