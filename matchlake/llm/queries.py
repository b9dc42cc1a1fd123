"""The numbered queries: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bitpack, bpe, codes, counts, descent, dialogue, fingerprints, interpolation, kneser, minhash, packing, secrets, toxicity
from .common import table

#: The tokenizer's file; a parameter of the operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COUNTED = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER, digest=True)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.read(bitpack.write(table(spark, sf_dir, "documents"), TOKENIZER), crc=True)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(table(spark, sf_dir, "conversations"), damage=True).summary


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(table(spark, sf_dir, "documents"), COUNTED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_quality_classifier,
        op2_nn_descent,
        op3_toxicity,
        op4_minhash_near_duplicates,
        op5_bpe_roundtrip,
        op6_best_fit_packing,
        op7_token_files,
        op8_secret_scan,
        op9_deleted_interpolation,
        op10_fingerprints,
        op11_conversation_repair,
        op12_vector_codes,
        op13_token_counts,
    )
    return {f.__name__: f for f in listed}


#: All pairs by shared shingles, then everything reachable by links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists),
runs AS (
  SELECT doc_id, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d
      || ' ' || lead(word, 4) OVER d AS g
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
  UNION
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) FROM words GROUP BY doc_id HAVING count(*) < 5),
sizes AS (SELECT doc_id, count(g) AS n FROM runs GROUP BY doc_id),
shingles AS (SELECT doc_id, n, g FROM runs JOIN sizes USING (doc_id) WHERE g IS NOT NULL),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT links.y, reached.root FROM reached JOIN links ON links.x = reached.doc_id WHERE reached.root < links.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.root AS component_id, c.root = d.doc_id AS kept
FROM documents d JOIN (SELECT doc_id, min(root) AS root FROM reached GROUP BY doc_id) c USING (doc_id)
  LEFT JOIN sizes USING (doc_id)
"""


def vector_codes(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    """Every part against every entry, round by round; distance and entry travel as one number."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, p, any_value(x) AS x, min({entries} * list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)]) + e) AS best
  FROM parts JOIN b{r} USING (p) GROUP BY rid, p)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT p, e, list(mean ORDER BY j) AS c FROM (
    SELECT p, best % {entries} AS e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS mean
    FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS j FROM a{r}) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, [CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT rid, vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x
  FROM (SELECT *, unnest(range({parts})) AS p FROM kept)),
started AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id, v LIMIT {entries}),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN started USING (rid)),{",".join(steps)},
coded AS (
  SELECT rid, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c[j] AS VARCHAR), ',' ORDER BY p, e, j)) FROM (SELECT p, e, c, unnest(range(1, len(c) + 1)) AS j FROM b{rounds})) AS codebooks_sha256
FROM coded JOIN kept USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    """The others need trained models, a tokenizer or hashes, which tests compare by brute force."""
    return {"op4_minhash_near_duplicates": NEAR_DUPLICATES, "op12_vector_codes": vector_codes()}
