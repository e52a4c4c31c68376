"""A corpus from raw documents to packed sequences: STAGES, applied in their order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but the last return
the columns of documents. Each works on all rows that the stage before kept, and its decisions take effect: texts that fail
the quality rules go, one document of each near-duplicate class stays, documents that share a passage with the benchmark go, personal
data and disclosing terms are replaced in the texts, and what is left is packed.

Null and empty texts have no words and go with the first stage; a null doc_id is kept and packed as null. Of repeated rows, as of near duplicates, one stays. Tables
without rows give none. Columns beyond those of documents, whatever their names, go through all stages but the last. A very long text is held whole by one task of each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sediment.llm import common, decontaminate, near_dedup, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("packing", packed)]

#: Tokens and weighted sampling are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
