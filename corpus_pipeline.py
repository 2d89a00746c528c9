"""A training-data pipeline over ``documents``: filter by quality, de-duplicate, cut repeats, mix sources, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.  Its
result is written as Parquet and read again as the next stage's input.

In every stage a null text is an empty one, texts are taken whole however long, rows without id pass through as documents of
their own, an empty table gives an empty table, and columns beyond those of ``documents`` are dropped.  What else a stage
makes of repeated ids and ties is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacetrace.functions.storage import clear_scratch, materialise, scratch_mark, scratch_path
from pacetrace.llm import packing, passages, quality
from pacetrace.llm.near_duplicates import near_duplicates
from pacetrace.llm.queries import QUALITY_FROM, WORD_BPE, mixed, table
from pacetrace.llm.workers import small_batches

#: Bytes of an Arrow batch and of an encoder's cache: less than in the operators alone, since the JVM is as large here as the
#: largest stage before made it, and workers stay between stages.
BATCH, CACHE = 4 << 20, 16 << 20
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of ``sf_dir``.

    Rows are judged one by one, so rows that repeat an id may part; a score of exactly ``QUALITY_FROM`` stays.
    """
    small_batches(spark, BATCH)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter(F.col("score") >= QUALITY_FROM).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Rows of one id are one document: they go or stay together, and of rows equal in id and text one stays.
    """
    small_batches(spark, BATCH)
    groups = near_duplicates(docs, num=80, den=100, bands=32, rows=6)
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(COLUMNS)
    again = materialise(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    once = left.join(again, "doc_id").dropDuplicates(["doc_id", "text"]).select(COLUMNS)
    return left.join(again, "doc_id", "left_anti").unionByName(once)


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has as well; ``n_chars`` is counted anew.

    A text that consists of such passages becomes empty and stays.
    """
    small_batches(spark, BATCH)
    found = materialise(passages.repeated_passages(docs).select("doc_id", "start_word", "end_word").distinct())
    cut = passages.without_passages(docs, found)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture; one that is taken in two epochs comes twice.  Ties in the order of an epoch go by id."""
    small_batches(spark, BATCH)
    return mixed(docs).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a training sequence, with the token ids.

    An empty text is its end id alone; each row of a repeated id is packed.
    """
    small_batches(spark, BATCH)
    return packing.pack(docs, WORD_BPE, capacity=2048, end_id=1, cache_bytes=CACHE)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", passages_once),
    ("mixture", mixture),
    ("packing", packed),
]

#: No SQL: the classifier, the tokenizer and the packing can't be expressed; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; the tables of a stage go when the next stage's result is written."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS), scratch_mark(spark)
    for name, stage in STAGES:
        made, path = stage(spark, docs, sf_dir), scratch_path(spark, name)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        clear_scratch(spark, since=mark, keep=(path,))
    return docs
