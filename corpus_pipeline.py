"""Five stages from raw documents to shards, each one operator of folio.llm.

Every stage is a function of (spark, docs, sf_dir) and works on all that the stage before it kept:
rejects of the quality classifier go, one document of each near-duplicate group stays, documents
that hold a benchmark passage go, sources are mixed to their target weights, and the mix is
dealt to shards.  run() writes each stage to the shared folder and reads it again.

Defined results: null and empty texts get a score like others; having no words they are linked with nothing and hold no
benchmark passage, and as they have no words to take the mix leaves them out.  Of rows with equal ids and texts one stays
after near_duplicates.  Null ids and sources are values like others; extra columns are carried through, whatever
their names, up to the end, where columns named size, text_crc32, vslot, shard or slot give way to those of the shards; an empty
table gives an empty result.  The rows of the last stage hold their texts and all other columns: written by shard, they are the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm.decontaminate import decontaminate
from folio.llm.jaccard_join import one_of_each_group
from folio.llm.mixing import mixed_documents
from folio.llm.quality import keep_good
from folio.llm.scratch import new_path
from folio.llm.sharding import shard_records

SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = shard_records(docs, shards=SHARDS)
    return rows


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier, the join and the hashed orders cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
