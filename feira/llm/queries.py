"""The registered queries of this package, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm import (chat, ctw, decontaminate, fragment_join, langid, licenses, merkle, mixing, near_dup, quality,
                       rollup, toxicity, zone_clusters)
from feira.llm._store import cut, scratch

#: Vocabulary in rank format and its split pattern (fixed values); both are parameters of the operators.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def crc_is_2(id_col: str, modulus: int) -> Column:
    """The fold that is held out: crc32 of the id as text, modulo ``modulus``, is 2."""
    return F.crc32(F.col(id_col).cast("string")) % modulus == 2


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"), crc_is_2("doc_id", 7))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents: every document is
    inserted under two tokenizer versions; all rows of a text but one (of the
    smallest id, a null one first) are deleted; words/1 (white space) is
    revised to words/2 (runs of letters and digits) for the rest. Each batch is
    committed twice, which changes nothing. Batches name rows, not ids, so
    repeated ids are counted right."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text", F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("same"),
        mixing.word_count(F.col("text")).alias("words_1"),
        F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")).cast("long").alias("words_2"))
    counts = cut(rollup.bpe_tokens(docs.withColumn("row", F.monotonically_increasing_id()), VOCABULARY, PATTERN, out="bpe"))
    first = counts.groupBy("same").agg(F.min(F.struct("doc_id", "row"))["row"].alias("first"))
    copies = counts.join(first, "same").filter(F.col("row") != F.col("first"))

    def of(rows: DataFrame, version: str, tokens: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(tokens).alias("tokens"), "bytes")

    def both(rows: DataFrame) -> DataFrame:
        return of(rows, "byte_bpe_50k/1", "bpe").unionByName(of(rows, "words/1", "words_1"))

    left = counts.join(copies.select("row"), "row", "left_anti")
    totals = rollup.Rollup(spark, scratch(spark, "token-rollup"))
    for _ in range(2):
        totals.commit("001-insert", rollup.signed(both(counts), 1))
        totals.commit("002-delete-copies", rollup.signed(both(copies), -1))
        totals.commit("003-revise-words", rollup.revised(of(left, "words/1", "words_1"), of(left, "words/2", "words_2")))
    return totals.totals()


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return chat.digests(chat.assemble(turns.unionByName(more), VOCABULARY, PATTERN), VOCABULARY, PATTERN)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), crc_is_2("doc_id", 4))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled(docs, toxicity.grades_of(_table(spark, sf_dir, "labels"))))
    return toxicity.score(docs, model).withColumn("toxic", F.col("p_toxic") >= toxicity.REJECT)


def op11_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clusters.clusters(_table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.check(merkle.document_leaves(_table(spark, sf_dir, "documents"), tampered))


def op13_fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_join.linked(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_ctw": op3_ctw,
    "op4_token_rollup": op4_token_rollup,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_licenses": op8_licenses,
    "op9_language": op9_language,
    "op10_toxicity": op10_toxicity,
    "op11_zone_clusters": op11_zone_clusters,
    "op12_merkle": op12_merkle,
    "op13_fragment_join": op13_fragment_join,
}
