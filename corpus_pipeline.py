"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's rows as Parquet
to the shared folder and reads them again. Side tables (labels) come from sf_dir. Columns of documents beyond the five named
ones are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import mixing, neardup, packing, pii, quality
from voxframe.llm.common import cut, table
from voxframe.llm.queries import default_tokenizer, surrogate_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that importance resampling rejects go."""
    return quality.resample(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each near-duplicate class stays."""
    return neardup.deduplicate(docs).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: texts get surrogates; n_chars stays the length before."""
    return pii.pseudonymise(docs, surrogate_key(spark)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document is repeated a Poisson number of times with its source's mean rate, in random order."""
    return mixing.poisson_mix(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: where each piece of each copy goes."""
    return packing.pack_documents(docs, default_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Models, signatures and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
