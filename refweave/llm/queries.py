"""One query per operator, over whole tables and with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from refweave.llm import bpe, collision_ann, cotrain, licenses, merkle, mixing, perplexity, pii, repair, repeats, simhash, tokens, warc
from refweave.llm.common import table, written
from refweave.session import scratch


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(
        table(spark, sf_dir, "documents"), "doc_id", "text",
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return collision_ann.nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", k=5)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii")
    return pii.report(pii.decide(found, pii.learn(found)), "doc_id")


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rules(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder, "page_id", "url", "html")
    return warc.read(spark, folder).drop("whole")


_SQL6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY t)
SELECT p.page_id, p.n::bigint AS payload_bytes, sha256(p.t) AS payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.t = f.t
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(
        table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json")
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "text_score", "page_score", "score", "kept")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


_SQL11 = """
WITH RECURSIVE
crc AS (  -- table of the CRC-32
  SELECT list(t ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_concat([n], list_transform(range(8), lambda x: 0::bigint)),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS t
    FROM (SELECT unnest(range(256))::bigint AS n))),
d AS (
  SELECT doc_id, lang, n_chars, sha256(concat(a, coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-'), z)) AS leaf,
    sha256(concat(a, coalesce(octet_length(encode((n_chars + 1)::varchar)) || ':' || (n_chars + 1), '-'), z)) AS more,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS sum32
  FROM (SELECT doc_id, lang, n_chars,
      concat(coalesce(length(doc_id::varchar) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
        coalesce(octet_length(encode(lang)) || ':' || lang, '-')) AS a,
      coalesce(octet_length(encode(text)) || ':' || text, '-') AS z FROM documents), crc),
leaves AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
nodes(tree, k, i, digest, n) AS (
  SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT tree, k + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, k, i // 2, n),
subroots AS (SELECT tree, digest, max(k) OVER () AS deepest, row_number() OVER (ORDER BY tree) - 1 AS i FROM nodes WHERE n = 1),
tops(k, i, digest, n) AS (
  SELECT 0, i, digest, count(*) OVER () FROM subroots
  UNION ALL
  SELECT k + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY k, i // 2, n),
-- Levels of both trees, numbered on; above a leaf each has at most one other child.
steps AS (
  SELECT l.tree, l.i, s.k, (l.i >> s.k) & 1 AS side, o.digest AS other
  FROM leaves l JOIN (SELECT DISTINCT tree, k FROM nodes WHERE n > 1) s ON s.tree = l.tree
  LEFT JOIN nodes o ON o.tree = l.tree AND o.k = s.k AND o.i = xor(l.i >> s.k, 1)
  UNION ALL
  SELECT l.tree, l.i, 100 + s.k, (r.i >> s.k) & 1, o.digest
  FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN (SELECT DISTINCT k FROM tops WHERE n > 1) s ON true
  LEFT JOIN tops o ON o.k = s.k AND o.i = xor(r.i >> s.k, 1)),
ways AS (SELECT tree, i, coalesce(string_agg(other, '' ORDER BY k), '') AS proof, list({'side': side, 'other': other} ORDER BY k) AS way
  FROM steps GROUP BY tree, i),
begun AS (SELECT l.*, coalesce(proof, '') AS proof, coalesce(way, []) AS way,
    CASE WHEN sum32 % 7 = 0 THEN more ELSE leaf END AS start
  FROM leaves l LEFT JOIN ways USING (tree, i)),
folds(tree, i, step, digest) AS (
  SELECT tree, i, 1::bigint, start FROM begun
  UNION ALL
  SELECT f.tree, f.i, step + 1, sha256(CASE WHEN way[step].other IS NULL THEN digest
    WHEN way[step].side = 1 THEN way[step].other || digest ELSE digest || way[step].other END)
  FROM folds f JOIN begun b ON b.tree = f.tree AND b.i = f.i WHERE step <= len(way))
SELECT b.doc_id, b.leaf, s.digest AS subroot, r.digest AS root, sha256(b.proof) AS proof_sha256, f.digest AS folded_root,
  f.digest = r.digest AS verified
FROM begun b JOIN subroots s ON s.tree = b.tree JOIN (SELECT digest FROM tops WHERE n = 1) r ON true
JOIN folds f ON f.tree = b.tree AND f.i = b.i AND f.step = len(b.way) + 1
"""


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repaired(repair.damage(rows), rows)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_byte_bpe, op2_simhash, op3_collision_ann, op4_pii, op5_perplexity, op6_warc, op7_token_counts, op8_licenses, op9_mixing,
        op10_cotraining, op11_merkle, op12_conversations, op13_repeats,
    )
    return {f.__name__: f for f in found}


def all_sql() -> dict[str, str]:
    return {"op6_warc": _SQL6, "op11_merkle": _SQL11}
