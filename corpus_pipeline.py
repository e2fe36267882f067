"""A corpus pipeline: each stage filters, repeats or places the documents that the one before it kept.

All stages take any columns beside doc_id and text (mixing: and source), and all but the last return the same columns. Null and empty
texts, null ids, repeated rows and empty tables are input like any other: each stage says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlog.llm import decontam, mixing, sharding, simhash, toxicity
from fernlog.llm.common import keep_only, made, small_batches, stored

#: SQL cannot express the toxicity model.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose every window is likelier harmless than toxic.

    Null and empty texts score 0 and stay, as do rows with a null id; repeated rows share their fate; without labels all stay.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return docs.where(toxicity.toxicity(docs, labels) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (Jaccard >= 0.8 on five words).

    Texts without words (null, empty, blank) are copies of each other, and repeated rows are too: one of them stays. Of a group
    a row with a null id stays only if no other has one.
    """
    small_batches(spark)
    return simhash.near_copies(docs).where(F.col("keep")).select("_row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Null, empty and short texts hold none and stay; equal texts share their fate, whatever their ids; without items all stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.clean(docs, benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned until each source meets its target share of words.

    A null source is a source of its own. Which documents get one copy more follows from a hash of their id and text, so that reruns
    agree, and repeated rows with the same id and text share it. A document without words is repeated like any other of its source.
    """
    return mixing.emit(mixing.mix(docs, by_text=True))


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard and slot that they go to; columns of these names in the input are replaced.

    Each row has a place of its own: the copies that mixing made and rows with null ids take adjoining ones.
    """
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return sharding.shard(docs).select(*own, "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written and read again as the next one's input.

    Once a stage's result is written, the scratch tables behind it and its input are deleted. An empty table gives an empty one.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
            keep_only(spark, before, docs)
    return docs
