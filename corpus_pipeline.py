"""A corpus pipeline: five stages over ``documents``, each an operator of
``loomarc.llm``.  Every stage is written as Parquet and read again as the next
one's input, so a lost executor repeats a part of one stage only.

Every stage decides on rows: null and repeated ids, null and empty texts and
texts of any length are documents like others, no rows give no rows, and
further columns, of whatever name, stay as they are."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomarc.llm import decontaminate, jaccard_join, mixing, token_files, toxicity
from loomarc.llm.common import id_fold, scratch_path, staged, with_table, without
from loomarc.llm.queries import _tokenizer
from loomarc.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labels, does not reject; a
    null or empty text is judged as one without a match."""
    ship_package(spark)
    labels = with_table(spark, sf_dir, "labels").where(id_fold(F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs, labels)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return toxicity.scored(rows, model).where(~F.col("_toxic")).select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, key): whole rows and a number that tells them apart.

    Rows of files have their place in them for a key and are read there again;
    others are written first, with numbers."""
    row = F.struct("*").alias("row")
    numbered = docs.select(row, F.monotonically_increasing_id().alias("key"))
    try:
        placed = docs.select(row, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("key"))
    except AnalysisException:
        return staged(numbered, "rows")
    # What came between the files and here may have made several rows of one.
    once = placed.groupBy("key").count().where("count > 1").isEmpty()
    return placed if once else staged(numbered, "rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, nulls
    last, then by text; repeated rows are duplicates as well.  Texts without
    words are no duplicates."""
    ship_package(spark)
    keyed = _keyed(docs)
    groups = jaccard_join.near_duplicate_groups(keyed.select(F.col("key").alias("doc_id"), F.col("row")["text"].alias("text")))
    alike = groups.where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id")
    doc_id = F.col("row")["doc_id"]
    rank = F.struct(F.isnull(doc_id).alias("none"), doc_id.alias("id"), F.xxhash64(F.col("row")["text"]).alias("text"), "key")
    ranked = staged(keyed.select("key", rank.alias("rank")).join(alike, "key"), "ranks")
    first = ranked.groupBy("component_id").agg(F.min("rank")["key"].alias("first"))
    drop = ranked.join(first, "component_id").where("key <> first").select("key")
    return without(keyed, "key", drop).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, with_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture: files and rows follow it."""
    ship_package(spark)
    return mixing.in_mixed_order(docs)


#: Bytes of a generation of pieces; executors hold other stages' memory too.
KEPT_PIECES = 16_000_000


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the rows read; per document doc_id, start,
    n_tokens and ids_crc32 as read back from them.

    Rows that do not come from files have no order, so doc_id gives it.
    """
    ship_package(spark)
    try:
        ordered = docs.select("doc_id", "text", F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
        order = "_at"
    except AnalysisException:
        ordered, order = docs, "doc_id"
    out = scratch_path(spark, "token-files")
    token_files.write_token_files(ordered, out, _tokenizer(), order=order, kept=KEPT_PIECES)
    return token_files.document_digests(spark, out)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: SQL has no form for the fitted grammar nor for the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
