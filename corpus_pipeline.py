"""A corpus pipeline of five stages, each calling one operator on all that the one before kept.

Every stage but the last returns the columns of documents. Each result is written as
Parquet in the shared folder and read again, so a stage starts from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm.common import DOC_COLUMNS, numbered, settle, table
from catalith.llm.language_id import fit_on, identify
from catalith.llm.line_dedup import dedup_lines
from catalith.llm.ngram_join import jaccard_classes
from catalith.llm.packing import pack
from catalith.llm.pii import redact_pii

#: Rows that a stage drops whose ids are sent to all executors at most; beyond it they are found by a join.
BROADCAST_IDS = 500_000
#: Characters that packing tokenizes in one go.
CHUNK = 1 << 20
#: Words that a worker remembers there.
REMEMBERED = 150_000


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*DOC_COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go (those without a letter among them); lang becomes the predicted one."""
    docs = docs.select(*DOC_COLUMNS)
    judged = identify(docs, fit_on(docs)).where(~F.col("rejected"))
    return judged.withColumn("lang", F.col("lang_pred")).select(*DOC_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of repeated runs go; a document that is nothing but copies goes."""
    clear = dedup_lines(docs.select(*DOC_COLUMNS))
    return _as_documents(clear.where("n_removed = 0 OR n_removed < n_lines"))


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents and rid, a number of each row's own."""
    return numbered(docs.select(*DOC_COLUMNS)).select("doc.*", "rid")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each linked group one row stays, that of the smallest doc_id (a null one is the largest).

    Rows are told apart by a number of their own: of rows that repeat a doc_id, each is
    judged by its text, and of rows that repeat a doc_id and a text, one stays. The
    result is the same under any partitioning of the same files.
    """
    rows = _numbered(docs)
    classes = jaccard_classes(rows.select(F.col("rid").alias("doc_id"), "text")).select(F.col("doc_id").alias("rid"), "class_id")
    members = settle(classes.join(rows.select("rid", "doc_id").hint("merge"), "rid"), "members")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"))
    firsts = members.groupBy("class_id").agg(F.min(place)["rid"].alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class_id", "first")
    gone = settle(members.join(firsts.hint("merge"), "class_id").where("rid <> first").select("rid"), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge")
    return rows.join(gone, "rid", "left_anti").select(*DOC_COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans are masked in the text by their kind."""
    return _as_documents(redact_pii(docs.select(*DOC_COLUMNS)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: a row for each piece of a document in a sequence. Workers have served four stages by now, so chunks are small."""
    return pack(docs, chunk=CHUNK, remembered=REMEMBERED)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("packing", sequences),
]

#: SQL has neither the trained models nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "_"))
    return docs
