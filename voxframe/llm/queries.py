"""The thirteen queries over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import collocations, gif, hnsw, langid, linededup, mixing, neardup, packing, periodic, pii, quality, sharding, warc
from voxframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


#: For the synthetic tables only: real data takes a key of its own, by the session's setting.
DEMO_KEY, KEY_SETTING = "voxframe-demo-key", "spark.voxframe.surrogate.key"


def surrogate_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEMO_KEY)


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES: dict[str, Query] = {
    "op1_hyperdimensional_language": _over("documents", langid.document_languages),
    "op2_gif_media": _over("documents", gif.store_documents),
    "op3_warc_revisits": _over("pages", warc.revisit_report),
    "op4_hypergeometric_shards": _over("documents", sharding.shard_documents),
    "op5_best_fit_packing": _over("documents", lambda docs: packing.pack_documents(docs, default_tokenizer())),
    "op6_hnsw_neighbours": _over("embeddings", lambda e: hnsw.nearest(e, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))),
    "op7_poisson_mix": _over("documents", mixing.poisson_mix),
    "op8_surrogates": lambda spark, sf_dir: pii.pseudonymise(table(spark, sf_dir, "documents"), surrogate_key(spark)).select("doc_id", "text", "n_entities"),
    "op9_importance_resampling": lambda spark, sf_dir: quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "source", "log_weight", "gumbel_key"),
    "op10_bagminhash_classes": lambda spark, sf_dir: neardup.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id"),
    "op11_periodic_runs": _over("documents", periodic.run_report),
    "op12_line_dedup": _over("documents", linededup.line_report),
    "op13_phrase_collocations": _over("documents", collocations.phrase_collocations),
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_revisits": warc.ORACLE_SQL,
    "op7_poisson_mix": mixing.ORACLE_SQL,
    "op12_line_dedup": linededup.ORACLE_SQL,
    "op13_phrase_collocations": collocations.ORACLE_SQL,
}
