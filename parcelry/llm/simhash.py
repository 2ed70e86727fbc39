"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two halves. Two fingerprints that differ in at most three bits have
a half in which they differ in at most one, so each fingerprint looks up, for either half, the
33 values within one bit of its own in a table of the halves, and complete distances are
verified for what it meets there. Links then make components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.components import components
from parcelry.llm.text import sliced, spaced_words
from parcelry.operators.merge import hash_join
from parcelry.session import Staging

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
HALF = 32
#: A half shared by more fingerprints than this is cut into cells of about that many.
CELL = 2048


def fingerprint_of(words: list[bytes], shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in more than half of the shingles' hashes."""
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(view[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(column: pa.Array) -> pa.Array:
    found = [fingerprint_of(spaced_words(t)) for t in column.to_pylist()]
    return pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer; NULL and texts without words give zero."""
    return F.arrow_udf("long")(sliced(_fingerprints))(text)


def hex_digits(fingerprints: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprints), 16, "0"))


def _entries(fingerprints: DataFrame) -> DataFrame:
    """For each half, the values within one bit of the fingerprint's own: the first is its own."""
    masks = F.array(F.lit(0), *(F.lit(1 << i) for i in range(HALF)))
    low = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    high = F.shiftrightunsigned(F.col("fp"), HALF)
    halves = F.array(
        F.struct(F.lit(0).cast("long").alias("side"), low.alias("value")),
        F.struct(F.lit(1 << HALF).alias("side"), high.alias("value")),
    )
    return (
        fingerprints.select("fp", F.explode(halves).alias("half"))
        .select("fp", "half", F.explode(masks).alias("mask"))
        .select(
            "fp",
            F.col("half.value").bitwiseXOR(F.col("mask")).bitwiseOR(F.col("half.side")).alias("key"),
            (F.col("mask") == 0).alias("own"),
        )
    )


def _in_cells(entries: DataFrame, fingerprints: DataFrame, staging: Staging, cell: int):
    """Give entries of much-shared halves a cell, so that each pair that has to be compared
    meets in one cell and no cell grows with its half. Others have cell 0."""
    low = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    high = F.shiftrightunsigned(F.col("fp"), HALF).bitwiseOR(F.lit(1 << HALF))
    crowded = staging.write(
        fingerprints.select(F.explode(F.array(low, high)).alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > cell)
        .select("key", F.ceil(F.col("n") / cell).cast("int").alias("cuts"))
    )
    if not crowded.rows:
        return entries.withColumn("cell", F.lit(0))
    table = F.broadcast(crowded.frame) if crowded.bytes < 8 << 20 else crowded.frame
    # Stored rows go to every column of their row of cells, seekers to every row of their column.
    cuts, own = F.col("cuts"), F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    others = F.sequence(F.lit(0), cuts - 1)
    cells = F.when(cuts.isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.col("own").alias("own"))))
    stored = F.transform(others, lambda j: F.struct((own * cuts + j).alias("cell"), F.lit(True).alias("own")))
    seeking = F.transform(others, lambda i: F.struct((i * cuts + own).alias("cell"), F.lit(False).alias("own")))
    both = F.when(F.col("own"), F.concat(stored, seeking)).otherwise(seeking)
    return (
        entries.join(table, "key", "left")
        .select("fp", "key", F.explode(cells.otherwise(both)).alias("x"))
        .select("fp", "key", F.col("x.own").alias("own"), F.col("x.cell").alias("cell"))
    )


class _Forest:
    """Union-find over what one task sees; a link within a tree is not told again."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = above
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the entries of each key and cell, which come one after another.

    Only links that join two trees of the task are given, so a dense group of g fingerprints
    gives g - 1 of them.
    """
    forest, rest = _Forest(), None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key: np.ndarray, cell: np.ndarray, fp: np.ndarray, own: np.ndarray):
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        stored = np.add.reduceat(own.astype(np.int64), starts)
        found = []
        for g in np.flatnonzero((stored > 0) & (ends - starts > 1)).tolist():
            x, mine = fp[starts[g] : ends[g]].view(np.uint64), own[starts[g] : ends[g]]
            table = x[mine]
            trees = np.array([forest.root(a) for a in table.tolist()], np.uint64)
            for a in x.tolist():
                near = np.bitwise_count(table ^ np.uint64(a)) <= MAX_DISTANCE
                mine_now = forest.root(a)
                # Once a dense group is one tree, hardly any entry is looked at again.
                for j in np.flatnonzero(near & (trees != np.uint64(mine_now))).tolist():
                    if forest.join(a, int(table[j])):
                        found.append((a, int(table[j])))
                if near.any():
                    top = np.uint64(forest.root(a))
                    trees[near] = top
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema)

    for batch in batches:
        table = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            table = [np.concatenate(x) for x in zip(rest, table)]
        key, cell = table[0], table[1]
        if not len(key):
            continue
        last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [c[cut:] for c in table]
        if cut:
            yield links(*(c[:cut] for c in table))
    if rest is not None and len(rest[0]):
        yield links(*rest)


def links(fingerprints: DataFrame, staging: Staging, cell: int = CELL) -> DataFrame:
    """Pairs (a, b) that span the groups of distinct ``fp`` linked at three bits or fewer.

    Every linked pair is met and verified; of the pairs that one task meets, those that join
    nothing new are left out.
    """
    entries = _in_cells(_entries(fingerprints), fingerprints, staging, cell)
    return (
        entries.select("key", "cell", "fp", "own")
        .repartition("key", "cell")
        .sortWithinPartitions("key", "cell")
        .mapInArrow(_verified, "a long, b long")
    )


def group_fingerprints(hashed: DataFrame, staging: Staging) -> DataFrame:
    """``fp``, ``first`` and ``component_id`` for the distinct fingerprints of ``doc_id``, ``fp``.

    ``first`` is the fingerprint's smallest id, ``component_id`` that of its component.
    """
    firsts = staging.write(hashed.groupBy("fp").agg(F.min("doc_id").alias("first"))).frame
    found = components(staging.write(links(firsts.select("fp"), staging)).frame, staging)
    named = firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return staging.write(hash_join(named, smallest, ["root"], "inner")).frame


def near_duplicates(docs: DataFrame, staging: Staging, doc: str = "doc_id", text: str = "text"):
    """``doc_id``, ``fp`` (signed) and ``component_id``: the smallest id reachable over links.

    Equal texts share a fingerprint and so a component; rows that come twice stay twice. NULL
    texts and texts without words have the fingerprint zero, linked like any other. A NULL id is
    no component's id unless all ids of the component are NULL. The result is read from the
    staging folder, so use it before the staging ends.
    """
    hashed = staging.write(
        docs.select(F.col(doc).alias("doc_id"), fingerprint(F.col(text)).alias("fp"))
    ).frame
    by_fp = group_fingerprints(hashed, staging).select("fp", "component_id")
    return hashed.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, staging: Staging, doc: str = "doc_id", text: str = "text"):
    """The rows of ``docs``, one for each component: the one with the smallest id.

    Of several rows with that id and the same fingerprint any one stays. The result is read from
    the staging folder, so use it before the staging ends.
    """
    rows = staging.write(
        docs.select(
            F.struct("*").alias("row"),
            F.col(doc).alias("doc_id"),
            fingerprint(F.col(text)).alias("fp"),
        )
    ).frame
    by_fp = group_fingerprints(rows.select("doc_id", "fp"), staging)
    order = F.struct(F.col("first").isNull(), "first", "fp")
    chosen = by_fp.groupBy("root").agg(F.min(order).alias("x")).select("x.first", "x.fp")
    kept = rows.alias("r").join(
        chosen.alias("c"),
        (F.col("r.fp") == F.col("c.fp")) & F.col("r.doc_id").eqNullSafe(F.col("c.first")),
        "left_semi",
    )
    repeated = staging.write(
        rows.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    )
    if repeated.rows:
        fps = repeated.frame.distinct()
        kept = kept.join(fps, "fp", "left_anti").unionByName(
            kept.join(fps, "fp", "left_semi").dropDuplicates(["doc_id", "fp"])
        )
    return kept.select("row.*")
