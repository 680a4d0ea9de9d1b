"""Queries of this subpackage on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise
from .canon import map_values
from .mixing import mix
from .names import known_of
from .subjects import assign_subjects, encode_corpus, repeated_footers, subjects_of, train
from .tokenize import encode_texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


TYPED = (("res_targets", "country", "country"), ("decommissioned_sites", "fuel_group", "fuel_group"))


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for name, column, field_name in TYPED:
        one = _table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), "row_id", F.lit(field_name).alias("field_name"), F.col(column).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    canon = _table(spark, sf_dir, "canon_values")
    return map_values(rows, canon, known_of(canon))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_values(spark, sf_dir).select("table_name", "row_id", "ref_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, _table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, _table(spark, sf_dir, "mix_targets"))[1]


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = materialise(encode_corpus(docs, repeated_footers(docs)), "sentences")
    subjects = subjects_of(_table(spark, sf_dir, "subject_list"))
    return assign_subjects(encoded, train(encoded, _table(spark, sf_dir, "subject_examples"), subjects), subjects)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_subjects(spark, sf_dir).select("doc_id", "subject_id")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents treat each subject, and their share of all that treat any."""
    found = p10_subjects(spark, sf_dir)
    counted = found.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_about").alias("n_sentences"))
    return _table(spark, sf_dir, "subject_list").select("subject_id", "subject_name").distinct().join(counted, "subject_id", "left").fillna(0, ["n_documents", "n_sentences"])


QUERIES = {"p3_found": p3_found, "p3_values": p3_values, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_subjects": p10_subjects, "p10_composition": p10_composition}
SQL: dict[str, str] = {}
