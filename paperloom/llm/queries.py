"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import archives, chatformat, decontaminate, langmix, linededup, maintext, mixing, neighbours, periodicruns, prefixtrie, shards, simhash, toxicity
from paperloom.llm.common import table


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.language_mixture(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.convert_pages(table(spark, sf_dir, "pages"))


def op4_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.edit_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicruns.digests(periodicruns.periodic_runs(periodicruns.planted(table(spark, sf_dir, "documents"))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(prefixtrie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = chatformat.with_control_texts(table(spark, sf_dir, "conversations"))
    return chatformat.digests(chatformat.read_back(chatformat.render(chatformat.fold(chatformat.log(told)))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_mixture,
        op2_main_text,
        op3_arc_to_warc,
        op4_edit_matches,
        op5_simhash_components,
        op6_cube_mix,
        op7_learned_partitions,
        op8_byte_shards,
        op9_line_dedup,
        op10_pu_toxicity,
        op11_periodic_runs,
        op12_prefix_trie,
        op13_chat_format,
    )
}
