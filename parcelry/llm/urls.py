"""URL rules by a blocked Bloom filter and an exact join.

A rule lists a host with a path prefix; it fits the host, its subdomains and every path that
begins so, and the longest rule wins. A URL has few such canonical forms: its host's suffixes
with the lengths of path that the list has. They are tested against the filter, and what may
be listed is joined with the list, which removes false positives.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 8  # of 64 bits: a block is one cache line
BITS = 8  # set in a block for each key
BITS_A_KEY = 12
MAX_BLOCKS = 1 << 18  # 16 MB; a longer list has more false positives, but no other result


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class BlockedBloom:
    """Each key sets bits in one block only, so a test touches one cache line."""

    blocks: np.ndarray  # n x WORDS of uint64

    @staticmethod
    def _place(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
        block = (hashes >> np.uint64(32)) % np.uint64(n)
        bits = np.stack(
            [(mixed >> np.uint64(9 * (i % 7) + i // 7)) & np.uint64(511) for i in range(BITS)], axis=1
        )
        return block.astype(np.int64), bits

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.blocks):
            return np.zeros(len(hashes), bool)
        block, bits = self._place(hashes, len(self.blocks))
        words = self.blocks[block[:, None], (bits >> np.uint64(6)).astype(np.int64)]
        return (words >> (bits & np.uint64(63)) & np.uint64(1)).all(axis=1)


def key_hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode(), 42)


def build_filter(listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> BlockedBloom:
    """The filter of the column ``key``.

    Tasks set the bits of their keys; Spark ors the words of a block, so the driver gets the
    finished blocks only, ``max_blocks`` at most.
    """
    n_keys = listed.count()
    if not n_keys:
        return BlockedBloom(np.zeros((0, WORDS), np.uint64))
    n = min(max_blocks, max(1, math.ceil(n_keys * BITS_A_KEY / (64 * WORDS))))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([key_hash(k) for k in batch.column(0).to_pylist()], np.uint64)
            block, bits = BlockedBloom._place(hashes, n)
            word = block[:, None] * WORDS + (bits >> np.uint64(6)).astype(np.int64)
            mask = (np.uint64(1) << (bits & np.uint64(63))).view(np.int64)
            yield pa.record_batch(
                [pa.array(word.ravel()), pa.array(mask.ravel())], names=["word", "mask"]
            )

    words = (
        listed.select("key")
        .mapInArrow(bits, "word long, mask long")
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toPandas()
    )
    blocks = np.zeros(n * WORDS, np.int64)
    blocks[words["word"].to_numpy()] = words["mask"].to_numpy()
    return BlockedBloom(blocks.view(np.uint64).reshape(n, WORDS))


def listed_keys(rules: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """``key``, ``verdict``, ``is_rule`` and the length of the path, of both lists.

    ``rules`` has ``host``, ``path`` and ``verdict``, ``blocked`` has ``host`` and ``path``. Rows
    with a NULL are left out; of rules listed twice ``block`` wins; a rule goes before an entry
    of ``blocked``.
    """
    rows = rules.select("host", "path", "verdict", F.lit(True).alias("is_rule"))
    if blocked is not None:
        rows = rows.unionByName(
            blocked.select(
                "host", "path", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")
            )
        )
    best = F.max(F.struct("is_rule", "verdict")).alias("best")
    return (
        rows.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(
            F.concat(F.lower("host"), "path").alias("key"), F.length("path").alias("path_length")
        )
        .agg(best)
        .select("key", "path_length", "best.verdict", "best.is_rule")
    )


def candidates(spark: SparkSession, bloom: BlockedBloom, lengths: list[int]) -> Callable:
    """A column function: the canonical forms of a host and path that may be listed."""
    shared = spark.sparkContext.broadcast(bloom)  # 64 * MAX_BLOCKS bytes at most

    def may_be_listed(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        keys, ends = [], [0]
        for host, path in zip(hosts.to_pylist(), paths.to_pylist()):
            if host:
                labels = host.split(".")
                prefixes = [path[:n] for n in lengths if n <= len(path)]
                for i in range(len(labels)):
                    suffix = ".".join(labels[i:])
                    keys += [suffix + prefix for prefix in prefixes]
            ends.append(len(keys))
        hashes = np.fromiter(map(key_hash, keys), np.uint64, len(keys))
        held = shared.value.may_hold(hashes)
        found = [
            [keys[i] for i in range(a, b) if held[i]] for a, b in zip(ends, ends[1:])
        ]
        return pa.array(found, pa.list_(pa.string()))

    return F.arrow_udf("array<string>")(may_be_listed)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    blocked: DataFrame | None = None,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` for every row.

    Without a rule that fits, ``rule`` is NULL and the verdict is ``block`` if ``blocked`` has an
    entry that fits, else ``default``. A NULL URL, or one without ``://``, has an empty host and
    path, and nothing fits it. Rows that come twice stay
    twice: rows are grouped by id and URL, as the verdict depends on nothing else, and each
    group is given out as often as it came. A group is summed up in every task before the
    shuffle, so one URL may be any share of the rows.
    """
    spark = pages.sparkSession
    listed = listed_keys(rules, blocked)
    lengths = [r[0] for r in listed.select("path_length").distinct().sort("path_length").collect()]
    test = candidates(spark, build_filter(listed, max_blocks), lengths)
    split = (
        pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
        .groupBy("page_id", "url")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("keys", test("host", "path"))
    )
    joined = split.select("*", F.explode_outer("keys").alias("key")).join(
        listed.select("key", F.col("verdict").alias("found"), "is_rule"), "key", "left"
    )
    longest = F.max_by(
        F.struct("key", "found"), F.when(F.col("is_rule"), F.length("key"))
    )
    return (
        joined.groupBy("page_id", "url", "host", "path", "copies")
        .agg(longest.alias("best"), F.count(F.when(~F.col("is_rule"), 1)).alias("entries"))
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.key").alias("rule"),
            F.coalesce(
                F.col("best.found"),
                F.when(F.col("entries") > 0, F.lit("block")).otherwise(F.lit(default)),
            ).alias("verdict"),
            F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        )
        .drop("copy")
    )
