"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontaminate import contamination
from .licenses import scan_licences
from .lines import dedup_lines
from .lm import score_texts
from .mixing import mixed
from .packing import pack
from .pstable import near_vectors
from .quality import quality_scores
from .scratch import read
from .simhash import simhash_components
from .spelling import variants, word_counts
from .toxicity import toxicity_scores
from .vptree import nearest
from .whitening import whitening_table


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))


def op4_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = read(spark, sf_dir, "embeddings")
    return nearest(vecs, vecs.where("vec_id % 100 = 0"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)


def op6_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")).drop("text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixed(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_table(read(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_toxicity": op2_toxicity,
    "op3_licences": op3_licences,
    "op4_vptree": op4_vptree,
    "op5_line_dedup": op5_line_dedup,
    "op6_pstable": op6_pstable,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_spelling": op13_spelling,
}

#: The other queries hash, search or train, for which SQL has no equivalent; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {"op12_decontamination": oracles.DECONTAMINATION, "op13_spelling": oracles.SPELLING}
