"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame; all but the last return the columns of documents. ``run`` writes
every stage's result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.llm import decontam, near_dup, packing, pii, toxicity
from basinflow.llm.common import Scratch, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the decision threshold."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), exclude_fold=None)
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate or equal rows: five-word shingles, similarity 0.8.

    Every row is judged by its own text, also where rows share an id; of a group the
    smallest id stays, then the smallest digest of the text. Texts without shingles are
    equal only to the same text under the same id. Rows without an id stay.
    """
    scratch = Scratch(spark, "dedup-stage")
    # written, so that a row keeps its number whenever it is read
    rows = scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = F.col("doc_id").isNotNull()
    found = near_dup.near_duplicates(rows.withColumn("_named", F.when(named, F.col("_row"))), "_named", shingle_words=5, percent=80)
    found = scratch.keep(found.where("row_id is not null").select(F.col("row_id").alias("_row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("_class")), "classes")
    narrow = rows.where(named).select("_row", F.col("doc_id").alias("_id"), F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("_digest"))
    best = F.min(F.struct("_id", F.col("_digest").isNull().alias("_none"), "_digest", "_row"))
    # a class is one group whatever its ids; without one the id and the text are the group
    alone = F.col("_class").isNull()
    group = ["_class", F.when(alone, F.col("_id")).alias("_k1"), F.when(alone, F.col("_digest")).alias("_k2")]
    stay = narrow.join(found.hint("merge"), "_row").groupBy(*group).agg(best.alias("_best")).select("_best._row")
    stay = scratch.keep(stay.unionByName(rows.where(~named).select("_row")), "stay")
    # the same join at every size: documents are dealt by row, once
    return rows.join(stay.hint("merge"), "_row", "left_semi").drop("_row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("private_data", redact_private_data),
    ("packing", pack_sequences),
]

#: Model fits and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
