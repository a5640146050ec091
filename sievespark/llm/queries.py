"""The registered queries of this package: thin projections of its operators onto the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .secrets import dictionary, find, train

    words = dictionary(public_tokenizers.path("word_bpe_49k.json"))
    return find(read_table(spark, sf_dir, "documents"), words, train(spark, words)).withColumnRenamed("id", "doc_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    found = encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find, fit, listed

    found = find(read_table(spark, sf_dir, "documents"), fit(spark))
    found = found.withColumn("base", F.concat(*KINDS)).withColumn("every", F.concat("base", "added"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    found = shard_rows(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    found = extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    found = round_trip(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op9_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    found = toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op10_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    found = quality(read_table(spark, sf_dir, "documents"), trusted)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")
    return found.select(F.col("id").alias("doc_id"), *names)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit, document_masks

    return audit(document_masks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import alignment

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(read_table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = materialize(found.select("row", "id", "n_a", "n_b", "n_groups", digest, "a", "b", "times"), "aligned")
    counts = materialize(alignment.pair_counts(aligned), "pair-counts")
    sums = alignment.link_sums(aligned, counts, alignment.bound_of(*paths))
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return aligned.drop("a", "b", "times").join(sums, "row", "left").select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "groups_sha256", *zero)


def op13_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hash_forest import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .filter_audit import AUDIT_SQL

    return {"op11_filter_audit": AUDIT_SQL}
