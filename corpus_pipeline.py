"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Between stages the
rows are written as Parquet and read again, so a lost executor costs a stage's tasks at most.

Defined cases: null and blank texts fail the quality rules, so later stages don't see them. Rows with a null
doc_id or source stay as their texts deserve; repeated rows and copies leave one row; very long texts are
treated whole. An empty table gives empty results. Columns beside doc_id, text, source and n_chars pass
through every stage but the last, whatever their names; packing returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bagminhash, line_dedup, mixing, packing, quality
from cairn.llm.common import cut, table
from cairn.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts boilerplate lines; n_chars is that of the text that stays."""
    return line_dedup.cleaned(docs, length="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("near dedup", near_dedup),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: Near-dedup and packing can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
