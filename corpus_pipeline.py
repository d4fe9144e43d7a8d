"""From documents to token ids in five stages, each over all rows that the one before it kept.

1 toxicity: documents that the model of toxic spans rejects go.
2 lines: of near-equal lines across all documents the earliest stays; every document stays, with what is left of it.
3 near duplicates: of each group of documents with similar sets of five-word shingles (Jaccard 0.8 and more), the one of
  the least id stays. SimHash fingerprints make candidates that these sets verify; what lies further apart is found exactly.
4 decontamination: documents that hold a benchmark passage go.
5 pieces: the texts as SentencePiece ids.

Stages 1 to 4 return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, lines, pieces, simhash, toxicity
from weft.llm.common import forget, written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("line_dedup", lines.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("pieces", pieces.stage),
]

#: A trained model, alignment and a tokenizer are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written to the shared folder and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
