"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and works on all that the
stage before kept. All but the last return the columns of ``docs``; the last returns one row per packed
piece. Stages go by row and by text, so they define null, empty, repeated and extra values as their
operators do: a null text counts as empty, and columns besides doc_id and text are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from priorwise.llm import decontaminate, exact_dedup, minhash, packing, quality
from priorwise.llm.common import held_out, stored

#: The classifier fits tables to its labels, which SQL can't express; stages are tested against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is under the threshold; labels of held-out ids are not learned."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels, ~held_out("id"))
    return quality.keep_good(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return minhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which ten consecutive words of a benchmark item occur."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, bin_id, capacity, offset of every piece of every document."""
    placed = packing.pack_documents(docs, carry=["doc_id"])
    return placed.select("doc.doc_id", "piece", "start", "length", "bin_id", "capacity", "offset")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
