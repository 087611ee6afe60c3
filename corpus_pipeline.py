"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; the tables beside the
documents (labels, benchmark) come from ``sf_dir``. Stages keep the columns of ``docs``; nulls, empty texts and
repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import fresh, materialize, release, sweep
from gleanery.llm.decontamination import decontaminate
from gleanery.llm.line_dedup import dedup_lines
from gleanery.llm.mixing import POWERS, default_dims, sample
from gleanery.llm.ngram_join import jaccard_components
from gleanery.llm.toxicity import fit, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the network calls toxic."""
    scored = score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep a repeated line in the first document that has it; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each near-duplicate component (5-word shingles, Jaccard 0.8); documents without an id stay."""
    found = jaccard_components(docs.select("doc_id", "text"), 5, 80, 100)
    name = fresh(docs, "extra")
    extra = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "extra")
    return docs.join(extra, F.col("doc_id") == F.col(name), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that overlap with a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample to the target weights of sources, languages and topics."""
    return sample(docs, default_dims(), powers=POWERS).select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]

#: The first stage is a trained network, which SQL can't express; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            release(before)
        sweep(spark)
    return docs
