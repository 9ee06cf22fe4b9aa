"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm import broken_pairs, form_duplicates, fusion, leakage, linkage, lookalikes, names, packing, subjects
from lapwing.llm.common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variants(names.author_names(table(spark, sf_dir, "registry"), table(spark, sf_dir, "citations_flat")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.matches(table(spark, sf_dir, "citations_flat"), table(spark, sf_dir, "registry")).select("citation_id", "record_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs.first_defect(broken_pairs.broken_pairs(table(spark, sf_dir, "manuscripts"))).select("doc_id", "defect")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.representatives(table(spark, sf_dir, "registry")).where("sole_best").select("group_id", "best_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = form_duplicates.form_duplicates(table(spark, sf_dir, "citations_flat"))
    return members.where("keep_id < id").select("keep_id", F.col("id").alias("citation_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = (
        table(spark, sf_dir, "citations_flat")
        .select(F.lit("citations_flat").alias("table_name"), F.col("citation_id").alias("row_id"), "title")
        .unionByName(table(spark, sf_dir, "registry").select(F.lit("registry").alias("table_name"), F.col("record_id").alias("row_id"), "title"))
    )
    score = lookalikes.bigram_counts(titles, "title")
    return lookalikes.look_alikes(titles, ["table_name", "row_id"], "title", score).select("table_name", "row_id").distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subjects.subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))
    return found.select("doc_id", "subject").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_containers": p7_containers, "p8_found": p8_found, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    return {}
