"""A training corpus from raw documents, in five stages.

    toxicity          documents predicted toxic go
    near duplicates   one document of each SimHash component stays
    decontamination   documents that hold benchmark passages go
    secrets           spans found are replaced by a mark; no document goes
    packing           sequences of 4096 ids, a row a piece

Each stage gets all its predecessor kept, from Parquet in the shared folder, so
a lost executor costs tasks of one stage at most.  All but the last return the
columns of ``documents``.

Nulls: a null text is empty for every stage: it is not toxic, holds no passage and
no secret, has fingerprint zero (so one such document stays of all that are linked
to it) and packs to its end id alone; null ids are kept.  Rows that repeat id and
text are one after the second stage, other rows that share an id are not.  Ties:
of a component the document with the smallest hash of id and text stays, which
doesn't depend on order or partitions.  Extra columns pass through all stages but
the last, whatever their names (those of the stages' own columns start with two
underscores).
Empty tables give an empty result, without labels nothing is toxic, without a
benchmark nothing is contaminated.  Texts of any length are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressmill.llm import common, decontam, packing, secret_scan, simhash, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels, lambda c: common.held_out(c, 4, 2))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.find(docs, spans_col="__secret_spans")
    return secret_scan.redact(found, length_col="n_chars", spans_col="__secret_spans")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: No SQL: compression lengths, components and packing have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
