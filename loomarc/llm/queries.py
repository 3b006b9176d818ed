"""Registered queries of the training-data operators, with SQL where it can
express them.  Each reads its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    jaccard_join,
    license_scan,
    minmax_dedup,
    mixing,
    periodic_runs,
    quality,
    secret_scan,
    suffix_tree,
    token_files,
    token_transducer,
    toxicity,
    vector_codes,
)
from .common import id_fold, scratch_path, with_table

#: Vocabulary file that the token queries use.
VOCABULARY = "byte_bpe_50k.json"


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = with_table(spark, sf_dir, "documents"), with_table(spark, sf_dir, "labels")
    held_out = id_fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), F.col("_toxic").cast("int").alias("predicted")
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    token_files.write_token_files(with_table(spark, sf_dir, "documents"), out, _tokenizer())
    return token_files.document_digests(spark, out)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(with_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_groups(with_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(with_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    return mixing.mixed(docs).select(
        "doc_id", "source", "chars", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.token_counts(with_table(spark, sf_dir, "documents"), _tokenizer())


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_table(spark, sf_dir, "documents")
    fold = id_fold(F.col("doc_id"), 7)
    return suffix_tree.scored(docs, fold != 2).withColumn("held_out", fold == 2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_decisions(with_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(with_table(spark, sf_dir, "documents"), with_table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(with_table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(coded).select(
        "row.vec_id",
        F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.codebooks_digest(codebooks)).alias("codebooks_sha256"),
    )


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose id hashes to a multiple of ten repeat a part of their
    words: of n words, word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    docs = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")))
    docs = docs.withColumn("p", (1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))))
    places = F.sequence(F.lit(0).cast("long"), F.size("w").cast("long") - 1)
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.array_join(F.transform(places, lambda i: F.get("w", source(i))), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_planted_runs(with_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("most_repeated")
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicate_groups(with_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_toxicity,
        op2_token_files,
        op3_license_scan,
        op4_jaccard_join,
        op5_secret_scan,
        op6_mixing,
        op7_token_counts,
        op8_suffix_tree,
        op9_quality_rules,
        op10_decontamination,
        op11_vector_codes,
        op12_periodic_runs,
        op13_minmax_dedup,
    )
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)),
pairs AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT x, x FROM pairs UNION SELECT b.x, reach.r FROM pairs b JOIN reach ON b.y = reach.doc_id),
low AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least(low.r, s.doc_id), s.doc_id)::BIGINT AS component_id
FROM sets s LEFT JOIN low USING (doc_id)"""

_OP13 = f"SELECT *, doc_id = component_id AS kept FROM ({_OP4.replace('>= 75 *', '>= 85 *')})"

_OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM sized),
lengths AS (SELECT DISTINCT k FROM sized),
grams AS (SELECT doc_id, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i, w FROM d, lengths),
met AS (SELECT doc_id, grams.k, i, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM grams) grams JOIN windows USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


_SQUARE = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 5))
_MEANS = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 5))


def _nearest(book: str) -> str:
    return f"SELECT vec_id, p, any_value(x) AS x, min({{'d': {_SQUARE}, 'e': e}}) AS best FROM parts JOIN {book} USING (p) GROUP BY vec_id, p"


def _updated(book: str, near: str) -> str:
    return f"""SELECT p, e, coalesce(m, c) AS c FROM {book} LEFT JOIN
  (SELECT p, best.e AS e, [{_MEANS}] AS m FROM {near} GROUP BY ALL) USING (p, e)"""


_OP11 = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[4 * p + 1:4 * p + 4] AS x FROM kept, range(16) t(p)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN seeds USING (vec_id)),
near0 AS MATERIALIZED ({_nearest("book0")}),
book1 AS MATERIALIZED ({_updated("book0", "near0")}),
near1 AS MATERIALIZED ({_nearest("book1")}),
book2 AS MATERIALIZED ({_updated("book1", "near1")}),
near2 AS MATERIALIZED ({_nearest("book2")}),
coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": license_scan.oracle(), "op4_jaccard_join": _OP4, "op10_decontamination": _OP10, "op11_vector_codes": _OP11, "op13_minmax_dedup": _OP13}
