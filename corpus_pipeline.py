"""A training-text pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import documents, stage
from quillspark.llm.exact import exact_stage
from quillspark.llm.langid import language_stage
from quillspark.llm.mixing import mixing_stage
from quillspark.llm.nearset import near_stage
from quillspark.llm.pieces import encode_stage

STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encode_stage),
]

#: No SQL expresses the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{n}")
    return docs
