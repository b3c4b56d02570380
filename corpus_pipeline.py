"""A training-data pipeline over the documents table: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.llm import byte_bpe, jaccard_join, line_dedup, mixing, quality_rules
from steadfast.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repetition rule reject go: null and empty texts, too, as they have under 50 words.

    Rows are judged one by one, however long or often repeated; an empty table gives no row.
    """
    return quality_rules.keep_documents(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines of 50 words or more go from the texts; texts of which nothing is left go as well.

    Rows with a null id or text stay as they are; rows that repeat id and text are one document and get the same text; n_chars
    follows the text where that was changed. A long text is split by lines; an empty table gives no row.
    """
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    whole = (F.col("n_removed") == 0) | (F.col("text") != "")
    return kept.filter(whole).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays: the one of the smallest id.

    Documents without words, and rows without an id, are in no group and stay. Rows with one id are one document, of which
    one row stays.
    """
    docs = docs.select(*COLUMNS)
    links = cut(jaccard_join.link_documents(docs, k=jaccard_join.SHINGLE, percent=jaccard_join.SIMILARITY).select("doc_id", "component_id").filter("doc_id is not null"))
    # what is decided about an id, from ids alone: texts meet these marks once, and only if any id goes or repeats
    decided = links.groupBy("doc_id").agg(F.min("component_id").alias("stays"), F.count("*").alias("n"))
    marks = cut(decided.filter("stays <> doc_id or n > 1").select("doc_id", (F.col("stays") != F.col("doc_id")).alias("goes")))
    if marks.count() <= jaccard_join.BROADCAST_ROWS:
        marks = F.broadcast(marks)
    stay = docs.join(marks, "doc_id", "left").filter("goes is null or not goes")
    single = stay.filter("goes is null").select(*COLUMNS)
    one = stay.filter("not goes").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", *(F.col(f"row.{c}") for c in COLUMNS[1:]))
    return single.unionByName(one)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in target weights: a document comes as often as the mix takes it, and not at all if that is never.

    Rows that repeat an id (for null ids: a text), size and source come equally often. An empty table gives no row.
    """
    return mixing.take(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them, for each row.

    Null texts count as empty; null ids and repeated rows are kept; memory follows the longest text; an empty table gives no row.
    """
    return byte_bpe.digest_documents(docs.select("doc_id", "text"), *byte_bpe.vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing sources", mix), ("byte-level BPE", encode)]

#: No SQL: repetition, components and BPE can't be expressed; tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
