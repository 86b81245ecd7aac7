"""A training-data pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
rereads it as the next stage's documents. Every stage but the last returns the columns of ``documents``.

In every stage a null text is an empty one (and stays null where it is kept), repeated rows are judged alike, a long text is read
whole, an empty table gives an empty one, and columns beside doc_id and text are carried along under whatever name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelia.llm import decontam, jaccard, lines, pieces, toxicity
from allelia.llm.shared import numbered, shared_dir


def _aside(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that none of their names can clash with one that a stage adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("others")] if others else []))


def _back(rows: DataFrame, docs: DataFrame, **changed: F.Column) -> DataFrame:
    """The columns of docs from rows by ``_aside``; some of them changed."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c) for c in docs.columns}
    return rows.select(*((own | changed)[c].alias(c) for c in docs.columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier chain, fitted on the labels, calls toxic; texts without words are not."""
    judged = toxicity.judge(_aside(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(judged.where("not toxic"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages of two lines or more out of the texts; a document that loses all its text goes. n_chars follows the text.

    The first occurrence stays: that of the smallest doc_id, null ids last."""
    left = lines.dedup_passages(_aside(docs)).where("n_removed = 0 or text <> ''")
    if "n_chars" not in docs.columns:
        return _back(left, docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("others").getField("n_chars"))
    return _back(left, docs, n_chars=n_chars)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class: that with the smallest doc_id (of equal ids, the smallest hash of the text)."""
    found = jaccard.near_duplicates(docs.select("doc_id", "text")).where("doc_id <=> class_id")
    one = found.groupBy("lead").agg(F.min("doc_id").alias("_doc"), F.min("text_key").alias("_key"))
    rows, names = numbered(docs)
    keyed = rows.withColumn("_text_key", F.xxhash64(names["text"]))
    kept = keyed.join(one, F.col(names["doc_id"]).eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")))
    return kept.dropDuplicates(["lead"]).select(*(F.col(c).alias(n) for n, c in names.items()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which a twentieth or more lies in benchmark windows."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the piece ids of the text with their number and digest, and a digest of the text that they decode to."""
    return pieces.digests(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: The classifier, the chosen paths and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
