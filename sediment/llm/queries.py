"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sediment.llm import common, decontaminate, html_blocks, lattice_lm, line_runs, lloyd, near_dedup, packing, pii, quality, release, sql, substring_dedup, token_file, toxicity

WORD_BPE, BYTE_BPE, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    token_file.write(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))
    return token_file.read(spark, path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("key")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(common.table(spark, sf_dir, "pages"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(common.table(spark, sf_dir, "documents"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scores(common.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(common.table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(common.table(spark, sf_dir, "documents"))


def op11_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.replay(common.table(spark, sf_dir, "conversations"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(common.table(spark, sf_dir, "embeddings"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(common.table(spark, sf_dir, "documents"))


_ALL = (op1_token_file, op2_toxicity, op3_quality, op4_decontaminate, op5_html, op6_near_dedup, op7_lattice, op8_pii, op9_packing, op10_substrings, op11_release, op12_lloyd, op13_lines)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op11_release": sql.OP11, "op12_lloyd": sql.OP12, "op13_lines": sql.OP13}
