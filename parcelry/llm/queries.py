"""The registered query of every operator here, over whole tables, with production settings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.llm import (
    bpe,
    classifier,
    clustering,
    decontaminate,
    language,
    licenses,
    pages,
    quality,
    ranking,
    simhash,
    toxicity,
    urls,
    warc,
)
from parcelry.session import Staging, work_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn_languages(docs)
    return docs.select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        language.languages(F.col("text"), model).alias("found"),
    ).select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        "found.score",
        "found.langs",
        "found.shares",
    )


#: Fixed values of the query: the rules, and hosts that are blocked where no rule fits. The hosts
#: are a stand-in for a list of bad hosts: they stand in the test pages.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
BLOCKED_HOSTS = [
    ("ads-track.example.com", "/"),
    ("casino-win.example.com", "/"),
    ("cheap-pills.example.com", "/"),
    ("free-bets.example.com", "/"),
]


def op2_urls(spark: SparkSession, sf_dir: str, blocked: DataFrame | None = None) -> DataFrame:
    """``blocked`` is a list with ``host`` and ``path``, in place of the stand-in."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    if blocked is None:
        blocked = spark.createDataFrame(BLOCKED_HOSTS, "host string, path string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules, blocked)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.quality(F.col("text"), quality.fit_references(docs))
    return docs.select("doc_id", judged.alias("q")).select("doc_id", "q.*")


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.Vocabulary(bpe.load_ranks(path), public_tokenizers.PATTERN)
    tokens = bpe.tokenized(spark, F.col("text"), vocabulary)
    return docs.select("doc_id", tokens.alias("t")).select(
        "doc_id",
        "t.n_tokens",
        F.sha2("t.ids", 256).alias("ids_sha256"),
        F.sha2("t.decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark, table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    with Staging(spark) as staging:
        lexicon = toxicity.learn_lexicon(docs, labels, staging)
    return docs.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        toxicity.toxicity(F.col("text"), lexicon).alias("found"),
    ).select("doc_id", "held_out", "found.score", "found.n_hits", "found.predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The result reads the archives, which therefore stay until the folder is cleared.
    folder = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    with Staging(spark) as staging:
        records = warc.resolve_revisits(table(spark, sf_dir, "pages"), staging)
        warc.write_archives(records, folder, date="2024-01-01T00:00:00Z")
    return warc.read_archives(spark, folder, payload=False).drop("payload")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = decontaminate.benchmark_windows(table(spark, sf_dir, "benchmark"))
    parts = decontaminate.window_parts(windows)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, parts).select("doc_id", "hits.*")
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        decontaminate.item_digest(F.col("items")).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The result reads the staged tables, which therefore stay until the folder is cleared.
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Staging(spark))
    return found.select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"), Staging(spark))


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = classifier.learn_quality(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id",
        classifier.held_out(F.col("doc_id")).alias("held_out"),
        classifier.quality_score(F.col("text"), trees).alias("found"),
    ).select("doc_id", "held_out", "found.*")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    # The result, ten rows an item, is staged, so the scans can go.
    with Staging(spark) as scans:
        return Staging(spark).write(ranking.search(docs, items, scans)).frame


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_language": op1_language,
        "op2_urls": op2_urls,
        "op3_licenses": op3_licenses,
        "op4_quality": op4_quality,
        "op5_bpe": op5_bpe,
        "op6_toxicity": op6_toxicity,
        "op7_warc": op7_warc,
        "op8_decontaminate": op8_decontaminate,
        "op9_simhash": op9_simhash,
        "op10_main_text": op10_main_text,
        "op11_quality_model": op11_quality_model,
        "op12_search": op12_search,
        "op13_clusters": op13_clusters,
    }
