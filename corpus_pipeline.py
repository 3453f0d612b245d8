"""From raw documents to packed training sequences, in five stages over whole tables.

`run` writes every stage's rows to the shared folder and reads them back for the
next.  Stages keep extra columns and rows without an id; see the operators for nulls,
ties and empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import language_id, mixing, ngram_join, packing, substring_dedup
from sluice.llm._executors import give_back
from sluice.llm._store import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language; it is learned from those that name theirs.

    The score does not matter: it falls with a text's length and with the number of languages.
    """
    kept = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    found = language_id.predict(docs.select(*[F.col(c).alias(k) for c, k in kept.items()]), language_id.train(docs), id_col=kept["doc_id"], text_col=kept["text"], keep=list(kept.values()))
    return found.where("lang_pred <> 'und'").select(*[F.col(k).alias(c) for c, k in kept.items()])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates (five words, 0.8); of repeated rows, one."""
    groups = stored(ngram_join.jaccard_components(docs))
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that repeat; a document that was nothing else goes.

    A document that loses nothing keeps its text as it was, spacing included.
    """
    kept = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    cut = substring_dedup.remove_repeats(docs.select(*[F.col(c).alias(k) for c, k in kept.items()]), text_col=kept["text"], keep=list(kept.values()), with_text=True)
    lost = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    columns = [(F.when(lost, new[c]).otherwise(F.col(k)) if c in new else F.col(k)).alias(c) for c, k in kept.items()]
    return cut.where((F.col("n_words") > F.col("n_removed")) | ~lost).select(*columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to tempered source weights, some more than once, others not at all."""
    kept = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    drawn = mixing.mix(docs.select(*[F.col(c).alias(k) for c, k in kept.items()]), target_entropy_share=0.97, most_repeats=4.0, id_col=kept["doc_id"], source_col=kept["source"], text_col=kept["text"])
    return drawn.select(*[F.col(k).alias(c) for c, k in kept.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def _after_the_last(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun on executors that hold nothing of the one before."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _after_the_last(known_language)),
    ("ngram_jaccard_join", _after_the_last(one_of_each_group)),
    ("substring_dedup", _after_the_last(without_repeated_passages)),
    ("source_mixing", _after_the_last(mixed_sources)),
    ("best_fit_packing", _after_the_last(packed)),
]

#: SQL cannot express the learned language model; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
