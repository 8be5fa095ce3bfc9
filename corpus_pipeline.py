"""From raw documents to packed training windows, in five stages.

Each stage reads what its predecessor kept, from Parquet in the shared folder. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stainloom.llm import queries
from stainloom.llm.common import SPACE, cut, maybe_in, stored, without
from stainloom.llm.exact_dedup import exact_dedup
from stainloom.llm.mixing import mix_rows
from stainloom.llm.near_dedup import near_dedup
from stainloom.llm.packing import pack
from stainloom.llm.quality import quality_rules

#: Budget and epochs of the mixture, those of op8: a share of what is left at which a domain with less
#: than its weight's part can be repeated up to it.
MIX_SHARE, MIX_EPOCHS = 0.6, 2


def _with_text(rows: DataFrame, names: list[str], text: Column, changed: Column) -> DataFrame:
    """rows with another text where it has changed, and the number of characters that goes with it."""
    rows = rows.withColumn("_text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(changed, F.char_length("_text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.withColumn("text", F.col("_text")).select(names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that the rules remove; rejected ones go.

    Each row is judged for itself, whatever its id.
    """
    names = docs.columns
    judged = quality_rules(docs.withColumn("_row", F.struct(*names)), extra=("_row",)).filter("kept")
    rows = judged.select("_row.*", F.col("clean_text").alias("_clean"), F.col("n_lines_removed").alias("_removed"))
    return _with_text(rows, names, F.col("_clean"), F.col("_removed") > 0)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id; of rows that repeat its id and text one.

    A null id is smaller than others. Only rows that may have an equal are shuffled.
    """
    names = docs.columns
    key = lambda sha: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha)
    groups = exact_dedup(docs).filter("group_size > 1").select(key(F.col("text_sha256")).alias("key"), "kept")
    groups = cut(groups.groupBy("key").agg(F.max("kept").alias("kept")))
    rows = docs.withColumn("_key", key(F.sha2(F.coalesce("text", F.lit("")), 256)))
    rows = maybe_in(rows, F.col("_key"), groups, F.col("key"), groups.count(), "_may")
    some = rows.filter("_may").dropDuplicates(["_key"]).join(groups.filter("not kept"), F.col("_key") == F.col("key"), "left_anti")
    return rows.filter("not _may").select(names).unionByName(some.select(names))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates over five-word shingles.

    Rows that repeat an id stay or go together, and stay if one of them does; a null id stays.
    """
    ids = near_dedup(docs, shingle=5).filter("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max("kept").alias("kept"))
    gone = cut(ids.filter("not kept").select("key"))
    return without(docs, F.col("doc_id").cast("long"), gone, gone.count())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mixture takes; the last of a leaf is cut after the tokens it gives."""
    words = F.regexp_extract_all("text", F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    rows = mix_rows(docs, MIX_SHARE, queries.WEIGHTS, queries.DOMAINS, max_epochs=MIX_EPOCHS)
    return _with_text(rows, docs.columns, F.array_join(F.slice(words, 1, F.col("_take")), ""), F.col("_take").isNotNull())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows; the columns of op7."""
    return queries.pieces(pack(docs, queries.tokenizer_source(), end_id=2))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]
#: Near duplicates and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
