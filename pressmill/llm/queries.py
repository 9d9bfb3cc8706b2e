"""The registered queries of this subpackage: operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, decontam, hard_negatives, langid, lm_score, packing, periodic, secret_scan, simhash, token_count, token_files, toxicity, vector_join


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda c: common.held_out(c, 4, 2))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(common.documents(spark, sf_dir).select("doc_id", "text")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "token-files")
    token_files.write_token_files(common.documents(spark, sf_dir), path)
    return token_files.read_token_files(spark, path)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(common.documents(spark, sf_dir), common.held_out("doc_id", 3, 1))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(common.documents(spark, sf_dir), common.held_out("doc_id", 7, 2))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(common.documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(common.documents(spark, sf_dir), rewrite=periodic.planted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": secret_scan.ORACLE_SQL, "op10_decontamination": decontam.ORACLE_SQL, "op11_vector_join": vector_join.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL, "op13_periodic_runs": periodic.ORACLE_SQL}
