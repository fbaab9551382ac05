"""The documents table as clean training data: five stages, each an operator of lexgraph.llm.

A doc_id names one document: rows that share one are kept or dropped together,
and repeated rows stay repeated. Rows without a doc_id are judged by their text in
the first two stages; the third and fourth, whose verdicts go by doc_id, leave them
in. Extra columns pass through all stages but the last; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgraph.llm import bpe, decontaminate, jaccard, linededup, quality
from lexgraph.llm.queries import word_bpe_path
from lexgraph.session import table, write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; null, empty and short texts go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; texts of nothing else stay whole."""
    return linededup.clean_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate group (five words, 0.8); texts without words are in no group."""
    found = jaccard.jaccard_components(docs, width=5, num=80, den=100)
    return docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item (five words, 0.8)."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row for each row; a null text has no tokens."""
    return bpe.encode_documents(docs, word_bpe_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("encoding", encoding)]

#: Trees and merge ranks are beyond SQL; tests/llm/test_pipeline.py compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
