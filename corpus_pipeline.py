"""Corpus pipeline: language ID, near-duplicate removal, repeated-span removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import op1_langid, op4_cube, op6_packing, op7_suffix, op8_chosen_path
from tidemark.llm.common import Work, documents
from tidemark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter, with the predicted language in ``lang``; null texts and texts without a letter go.

    The classifier learns from the documents of the stage's input that are not
    held out and have a language.  Repeated ids are predicted once for each text.
    """
    work = Work(spark, "stage-language")
    model = op1_langid.train(docs.where(~op1_langid.held_out(F.col("doc_id"))).select("lang", "text"), work)
    kept = docs.where(F.col("text").rlike(r"\p{L}"))
    return op1_langid.annotate(kept, model).where(F.col("lang_pred") != op1_langid.UNKNOWN).select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id; equal rows are one document."""
    classes = op8_chosen_path.similar(docs, work=Work(spark, "stage-jaccard"))
    chosen = classes.where("class_key is not null").groupBy("class_key").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    alone = classes.where("class_key is null").select("doc_id", "row_key")
    stay = chosen.select("first.*").unionByName(alone).distinct()
    keyed = docs.withColumn("row_key", op8_chosen_path.row_key())
    return keyed.join(stay.select(F.col("doc_id").alias("_d"), "row_key"), "row_key").where(F.col("doc_id").eqNullSafe(F.col("_d"))).dropDuplicates(["row_key"]).select(*COLUMNS)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that also start in an earlier document, cut at whole characters; emptied documents go."""
    found = op7_suffix.repeats(docs, span=50, work=Work(spark, "stage-suffix"), whole_characters=True, columns=("lang", "source"))
    text = F.decode("kept", "UTF-8")
    return found.where(F.length("kept") > 0).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times); rows with a null id too."""
    key = F.coalesce("doc_id", "h").alias("k")  # with the hash it names a row, never null
    taken = op4_cube.mix(docs, work=Work(spark, "stage-mixing")).where("copies > 0")
    taken = taken.groupBy(key, "h").agg(F.sum("copies").cast("int").alias("copies"))
    one = docs.withColumn("h", op4_cube.row_hash()).withColumn("k", key).dropDuplicates(["k", "h"])  # dealt as the join needs it
    return one.join(taken, ["k", "h"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their token ids."""
    return op6_packing.pack(docs, tokenizer_path(), 2048, 1, Work(spark, "stage-packing"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language ID, sampling and packing have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
