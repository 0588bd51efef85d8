"""The registered queries of this subpackage: ``opN_<name>`` and ``pipeline``, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.llm import decontaminate, divergence, fingerprints, language, licenses, mixing, repeats, secrets, similar, spelling, sql, toxicity, urls, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("hits")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, urls.repeated(pages)).select("page_id", "host", "path", "rule", "verdict")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_read(spark, sf_dir, "documents")).drop("kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_known", "sequence", F.array_join("leftover", ",").alias("leftover"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_read(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_read(spark, sf_dir, "documents"), compact=True)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_url_filter": op2_url_filter,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_warc": op6_warc,
        "op7_fingerprints": op7_fingerprints,
        "op8_mixing": op8_mixing,
        "op9_secret_scan": op9_secret_scan,
        "op10_toxicity": op10_toxicity,
        "op11_language_id": op11_language_id,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
