"""The training-data queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlog.llm import ann, chat, decontam, hard_negatives, langid, lexical, lm, mixing, secret_scan, sharding, simhash, toxicity, warc
from fernlog.llm.common import fold, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, rows=False)
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", taken)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    # only the keys go on from here: the texts stay behind
    keys = sharding.shard(docs).select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
    return keys


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = toxicity.toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    scored = docs.select("doc_id", held, score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # what was found is told by its digest: the value itself stays in the documents
    return found.select("doc_id", "word_no", "part", F.sha2("candidate", 256).alias("digest"), F.length("candidate").alias("length"), "held_out", "score", "secret")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.rank_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    # every seventh label is wrong by one, as in mined data
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", wrong), F.col("vec_id") % 100 == 0)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))], rows.schema)
    found = chat.digests(chat.format_trees(chat.threads(rows.unionByName(odd)), branches=1))
    return found.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES = {"op1_lm_score": op1_lm_score, "op2_simhash": op2_simhash, "op3_mix_sources": op3_mix_sources, "op4_neighbours": op4_neighbours, "op5_warc": op5_warc, "op6_decontaminate": op6_decontaminate, "op7_language": op7_language, "op8_shard": op8_shard, "op9_toxicity": op9_toxicity, "op10_secrets": op10_secrets, "op11_lexical": op11_lexical, "op12_hard_negatives": op12_hard_negatives, "op13_chat": op13_chat}
ORACLES = {"op3_mix_sources": mixing.ORACLE, "op5_warc": warc.ORACLE, "op11_lexical": lexical.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_chat": chat.ORACLE}
