"""The cleaning pipeline over ``documents``: each stage reads what the one before it kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame. ``run`` writes each stage as Parquet in the session's shared folder and reads it back
as the next one's ``docs``, so a lost executor costs the tasks of one stage.

1. ``toxicity`` fits on the labels of all documents that ``docs`` still holds and drops what scores 0.5 or more.
2. ``near_dedup`` keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), that of the least id.
3. ``decontamination`` drops documents that share a window with a benchmark item.
4. ``secrets`` keeps every document, puts a mark in place of secrets in its text, and counts n_chars again.
5. ``packing`` cuts and packs the texts; its rows are the pieces with their sequences.

The first four return the columns of ``docs`` as they are. Columns other than doc_id and text are
carried along, and n_chars is added to only where it is there. An empty table passes through all
stages; NULL texts count as empty and are never dropped but as copies of their own row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import decontamination, near_dedup, packing, secrets, toxicity
from panelweave.llm.common import Stages, ship

TOXIC_FROM = 0.5
#: Percent of shared five-word shingles from which on documents are near-duplicates; the query op6 has its own.
SIMILAR_FROM = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.training_rows(docs, labels, F.lit(True)))
    return toxicity.score(docs, model, "__toxicity").where(F.col("__toxicity") < TOXIC_FROM).drop("__toxicity")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs, SIMILAR_FROM)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.mask_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, the connected components or the packing; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents`` and return the rows of the last."""
    ship(spark)
    stages = Stages(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stages.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            stages.drop(before)
        before = docs
    return docs


PIPELINE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
PIPELINE_SQL: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
