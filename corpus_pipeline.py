"""From raw documents to packed training sequences, in five written stages.

Each stage is one operator of ``cadenza.llm`` over everything its predecessor
kept. The first four return documents with the columns of the input; the last
returns the packed pieces.

* ``quality_rules``: documents that the rules reject go.
* ``line_dedup``: lines with an earlier line within one edit go; a document that
  loses its last word with them goes too.
* ``near_duplicates``: of each group linked by a Jaccard similarity of 0.8 or
  more over five-word shingles, the document with the smallest doc_id stays.
* ``decontamination``: documents contaminated with benchmark items go.
* ``packing``: the rest becomes token pieces in sequences.

Packing and the edit distances of lines aren't expressible in SQL, so there is
no ORACLE_SQL; ``tests/llm`` compares the operators behind the stages with
brute-force versions on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.common import table, written
from cadenza.llm.op1_jaccard import keep_one
from cadenza.llm.op3_decontaminate import drop_contaminated
from cadenza.llm.op4_lines import clean_documents
from cadenza.llm.op8_bestfit import pack_documents
from cadenza.llm.op10_quality import filter_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
