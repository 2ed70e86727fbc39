"""A pipeline over ``documents``: from raw text to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept;
its result is written and read again. All but the last give rows with the columns of
``documents``. Empty tables, NULLs and repeated rows are handled as the operators say:

- quality: rows whose text the rules reject go, NULL and short texts among them;
- toxicity: rows whose score is 0.7 or more go;
- near duplicates: of each component of linked fingerprints the row with the smallest id stays;
- decontamination: rows in which a window of a benchmark item occurs go;
- tokens: ``doc_id``, ``n_tokens`` and the digests of the ids and of the decoded bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.llm import decontaminate, quality, simhash, toxicity
from parcelry.llm.queries import token_digests, table
from parcelry.session import Staging, delete_folder, work_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = quality.quality(F.col("text"), quality.fit_references(docs))
    return docs.where(verdict["kept"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with Staging(spark) as staging:
        lexicon = toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels"), staging)
    return docs.where(toxicity.toxicity(F.col("text"), lexicon)["predicted"] == 0)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The result reads the staged tables, which therefore stay until the folder is cleared.
    return simhash.one_of_each(docs, Staging(spark))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    windows = decontaminate.benchmark_windows(table(spark, sf_dir, "benchmark"))
    parts = decontaminate.window_parts(windows)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return (
        decontaminate.with_hits(rows, parts).where(F.size("hits.spans") == 0).select("row.*")
    )


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(spark, docs)


STAGES = [
    ("quality rules", keep_good),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level bpe", tokenize),
]

#: None: learnt models, components and token ids cannot be expressed in SQL. The tests compare
#: the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        path = f"{folder}/{number}"
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if number:  # what this stage read is not needed any more
            delete_folder(spark, f"{folder}/{number - 1}")
    return docs
