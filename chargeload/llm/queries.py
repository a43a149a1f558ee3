"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeload.config import scratch_path

from . import sql
from .common import crc32_mod, table


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("dedup.n_bytes").alias("n_bytes"),
        (F.col("dedup.n_bytes") - F.octet_length("dedup.kept")).cast("bigint").alias("n_removed"),
        F.size("dedup.spans").cast("bigint").alias("n_spans"),
        F.sha2("dedup.kept", 256).alias("kept_sha256"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_copies

    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score_texts

    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), crc32_mod(F.col("doc_id"), 5) == 1)


def op3_int8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, F.col("vec_id") % 50 == 0)


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_texts

    return pack_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_texts, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = crc32_mod(F.col("doc_id"), 3)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder != 1)
    return score_texts(docs, train(docs, labels), remainder == 1).select("doc_id", "held_out", "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import select_epochs

    return select_epochs(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import draw

    return draw(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def op13_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place

    return place(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "slot-map"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_pitman_yor, op3_int8_search, op4_html_blocks, op5_suffix_dedup, op6_jaccard_join,
    op7_best_fit, op8_toxicity_grammar, op9_quality_rules, op10_source_mixing,
    op11_ranked_search, op12_resampling, op13_slot_sharding,
)}
ORACLES: dict[str, str] = dict(sql.ORACLES)
