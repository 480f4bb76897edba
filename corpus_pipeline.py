"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

Toxic documents go, one document of each group of near copies stays, documents
with benchmark passages go, secrets are masked in the text, and the rest, with
its text, is mixed to target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import pipeline_stages as stages
from tessera.llm.common import discard, finished, materialize, scratch_dir

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_contaminated),
    ("secrets", stages.mask_secrets),
    ("mixing", stages.mix_sources),
]

#: The first stage scores with a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The last stage's rows, from the whole table ``documents``.

    With a ``run_id`` the stages' tables keep that name, and a run that starts again reads those that were finished.
    Without one a stage's table goes as soon as the next one is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{run_id}/{name}" if run_id else None
        before = docs
        if path and finished(spark, path):
            docs = spark.read.parquet(path)
            continue
        docs = materialize(stage(spark, before, sf_dir), name, path)
        if not run_id:
            discard(before)
    return docs
