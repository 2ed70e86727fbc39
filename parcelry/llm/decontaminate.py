"""Benchmark decontamination: windows of normalised benchmark words sought in documents.

The distinct windows of the benchmark are hashed and broadcast. A scan rolls the same hash
over each document; where the hash is known the words themselves are compared, so that a
collision counts for nothing. The words that a window covers are hit, and their spans or the
whole document can be removed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.llm.text import _WORD_BYTES, plain_words, sliced, slices

WINDOW = 10
#: Broadcast at most so many bytes of windows at once; a larger benchmark is taken in parts.
MAX_BROADCAST_BYTES = 64 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """A part of the benchmark's windows: by length and hash, the words and the items."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        self.windows = [(w.encode(), items) for w, items in windows]

    @cached_property
    def _index(self) -> tuple[dict[bytes, int], dict[int, tuple[np.ndarray, dict]]]:
        ids: dict[bytes, int] = {}
        by_length: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for text, items in self.windows:
            words = text.split()
            own = np.array([ids.setdefault(w, len(ids) + 1) for w in words], np.uint64)
            by_length[len(words)][int(_rolled(own, len(words))[0])].append((words, items))
        return ids, {
            n: (np.sort(np.fromiter(found, np.uint64, len(found))), dict(found))
            for n, found in by_length.items()
        }

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, length) of the windows that occur, and their items."""
        ids, by_length = self._index
        spans, items = [], set()
        own = np.fromiter(map(ids.get, words, repeat(0)), np.uint64, len(words))
        for n, (hashes, known) in by_length.items():
            if n > len(words):
                continue
            starts = _runs(own, n)
            if not len(starts):
                continue
            rolled = _rolled(own, n)[starts]
            place = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for i in np.flatnonzero(hashes[place] == rolled).tolist():
                start = int(starts[i])
                for wanted, found in known[int(rolled[i])]:
                    if words[start : start + n] == wanted:
                        spans.append((start, n))
                        items.update(found)
        return spans, items


def _runs(own: np.ndarray, n: int) -> np.ndarray:
    """Starts of n words that are all known to the benchmark."""
    if n == 1:
        return np.flatnonzero(own)
    sums = np.concatenate(([0], np.cumsum(own > 0)))
    return np.flatnonzero(sums[n:] - sums[:-n] == n)


def _rolled(own: np.ndarray, n: int) -> np.ndarray:
    found = np.zeros(len(own) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            found = found * _FACTOR + own[k : len(own) - n + 1 + k]
    return found


def benchmark_windows(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Distinct windows with the items that hold them: ``words`` (joined by spaces), ``items``.

    A text of fewer words than a window, but not none, is one window. NULL texts have none; a
    NULL item's windows count, without an item to name.
    """

    def windows(column: pa.Array) -> pa.Array:
        found = []
        for value in column.to_pylist():
            words = plain_words(value)
            n = min(window, len(words))
            found.append(
                sorted({b" ".join(words[i : i + n]).decode() for i in range(len(words) - n + 1)})
                if n
                else []
            )
        return pa.array(found, pa.list_(pa.string()))

    return (
        benchmark.select(
            F.col(item).cast("string").alias("item"), F.explode(F.arrow_udf("array<string>")(sliced(windows))(text)).alias("words")
        )
        .groupBy("words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def window_parts(windows: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> list[Windows]:
    """The windows in parts of at most about ``limit`` bytes each."""
    size = F.octet_length("words") + 8 * F.size("items")
    total = windows.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    n = max(1, -(-total // limit))
    part = F.pmod(F.xxhash64("words"), F.lit(n))
    return [
        Windows([(r.words, r.items) for r in windows.where(part == i).sort("words").toLocalIterator()])
        for i in range(n)
    ]


def hits(spark: SparkSession, text: Column, part: Windows, before: Column | None = None) -> Column:
    """The number of words and what occurs in a text, as a struct.

    ``spans`` has the starts and lengths of the windows found, ``items`` the items, as strings,
    sorted, without repeats. ``before`` is the result for another part of the windows, which is
    added. NULL and the empty text have no words and no hits.
    """
    shared = spark.sparkContext.broadcast(part)

    def scan(column: pa.Array, earlier: pa.Array) -> pa.Array:
        part = shared.value
        counts, spans, items = [], [], []
        for value, old in zip(column.to_pylist(), earlier.to_pylist()):
            words = plain_words(value)
            found, names = part.find(words)
            if old:
                found = sorted({*found, *((s["start"], s["n"]) for s in old["spans"])})
                names = names.union(old["items"])
            counts.append(len(words))
            spans.append([{"start": a, "n": n} for a, n in found])
            items.append(sorted(names))
        return pa.StructArray.from_arrays(
            [
                pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(_SPAN)),
                pa.array(items, pa.list_(pa.string())),
            ],
            names=["n_words", "spans", "items"],
        )

    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, earlier in batches:
            yield from map(scan, slices(column), slices(earlier))

    result = "n_words long, spans array<struct<start:int,n:int>>, items array<string>"
    return F.arrow_udf(result)(apply)(
        text, F.lit(None).cast("string") if before is None else before
    )


_SPAN = pa.struct([("start", pa.int32()), ("n", pa.int32())])


def with_hits(docs: DataFrame, parts: list[Windows], text: str = "text", name: str = "hits"):
    """The documents with the column ``name``: what of all parts occurs in the text."""
    for i, part in enumerate(parts):
        before = F.col(name) if i else None
        docs = docs.withColumn(name, hits(docs.sparkSession, F.col(text), part, before))
    return docs


def hit_words(spans: Column) -> Column:
    """How many words the spans cover."""
    covered = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"])))
            .alias("n"),
        ),
    )
    return covered["n"].cast("long")


def item_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def _without(column: pa.Array, spans: pa.Array) -> pa.Array:
    cleaned = []
    for value, found in zip(column.to_pylist(), spans.to_pylist()):
        if value and found:
            drop = {w for s in found for w in range(s["start"], s["start"] + s["n"])}
            value = _drop_words(value, drop)
        cleaned.append(value)
    return pa.array(cleaned, pa.string())


def _drop_words(text: str, drop: set[int]) -> str:
    data = text.encode()
    kept, end = [], 0
    for i, word in enumerate(re.finditer(rb"[^ ]+", data.translate(_WORD_BYTES))):
        if i in drop:
            kept.append(data[end : word.start()])
            end = word.end()
    return b"".join([*kept, data[end:]]).decode()


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words that spans cover; what separates words stays."""
    return F.arrow_udf("string")(_without)(text, spans)
