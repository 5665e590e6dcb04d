"""A pipeline that turns documents into packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it written as Parquet and reread, so a
lost executor costs at most the tasks of the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm import language_id, near_dedup, packing, quality, scratch, suffix_dedup
from telltale.llm.queries import vocabulary

#: Below this score a language is a guess; clean texts of any length stay well above.
LEAST_SCORE = 0.3
_TAG = "pipeline"


def _begin(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What earlier stages kept aside goes: their results are written by now.

    Texts go to Python in small batches from here on: the setting holds for the session, as stages run after their functions return.
    """
    scratch.release(spark, _TAG)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, frequent lines leave the others' texts.

    Null, empty and short texts are rejected by the base rules. Each row is judged by its own text and source (null: the source ""),
    so null or repeated ids don't matter and repeated rows fare alike. An empty table stays empty.
    """
    return quality.clean(_begin(spark, docs), tag=_TAG)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no or no recognisable language go; where no label allows a model, only those without a letter.

    Null and empty texts go. Texts are read whole, whatever their length. Equal texts fare alike, and ids only say which labelled rows
    are held out. An empty table stays empty.
    """
    docs = _begin(spark, docs)
    model = language_id.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language_id.identify(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model)
    return told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one of the smallest id.

    Texts without words are classes of their own and stay, and so do rows with a null id; rows that repeat the kept id all stay. An empty
    table stays empty.
    """
    return near_dedup.one_of_each(_begin(spark, docs), tag=_TAG)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that occur more than once, in one document or several, leave the texts; all documents stay.

    White space between the words doesn't matter, as copies of a passage are often wrapped anew. Null, empty and short texts and rows
    with a null id stay as they are. An empty table stays empty.
    """
    return suffix_dedup.clean(_begin(spark, docs), words=50, tag=_TAG)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences of 1024: a row for each piece.

    Null and empty texts are an end token alone; longer ones than a sequence are cut. Rows that repeat an id, or have none, are packed each
    for itself. An empty table gives no rows.
    """
    return packing.pack(_begin(spark, docs), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, entries=30_000, tag=_TAG)


STAGES = [("quality rules", quality_rules), ("language ID", language), ("near-duplicates", near_duplicates), ("suffix-array dedup", repeated_substrings), ("best-fit packing", packed)]

#: Neither the classifier nor the alignment can be put as SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch.new_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
