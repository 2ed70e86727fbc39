"""Languages of a text as a mixture.

Each language has a distribution over n-grams of bytes, hashed into a table of fixed size. The
n-grams of a text are drawn from a mixture of these; expectation-maximisation estimates the
proportions. The set of languages grows, the likeliest first, while the likelihood gains more
than the penalty for one more proportion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.text import sliced, slices

UNDETERMINED = "und"
N = 3
BUCKETS = 1 << 15

#: Letters and what is beyond ASCII stay, all else separates words.
_LETTERS = bytes(
    c | 0x20 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 0x20 for c in range(256)
)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams in a text, and how often each comes."""
    words = b" ".join(text.lower().encode().translate(_LETTERS).split())
    data = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    mixed = data[: len(data) - N + 1]
    for k in range(1, N):
        mixed = mixed * np.uint32(0x9E3779B1) + data[k : len(data) - N + 1 + k]
    mixed = mixed * np.uint32(0x85EBCA6B)
    counts = np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass(frozen=True)
class Languages:
    """The names and, in their order, the probabilities of n-grams: a column for a language."""

    names: list[str]
    grams: np.ndarray


@dataclass(frozen=True)
class Fit:
    """How the mixture is fitted.

    ``penalty`` is that for one more language, in units of half the logarithm of the number of
    n-grams. Neighbouring n-grams share bytes and so are worth less than free draws; ``worth``
    is their worth in such draws.
    """

    rounds: int = 12
    penalty: float = 4.0
    worth: float = 1 / N


def _mixture(grams: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of the mixture of all columns."""
    total = counts.sum()
    shares = np.full(grams.shape[1], 1 / grams.shape[1])
    for _ in range(rounds):
        joint = grams * shares
        shares = (counts / joint.sum(axis=1)) @ joint / total
    return shares, float(counts @ np.log(grams @ shares))


def infer(text: str | None, model: Languages, fit: Fit = Fit()) -> tuple[list[str], list[float]]:
    """The languages of a text and their proportions, the largest first; none without letters."""
    if not text or not model.names or not any(map(str.isalpha, text)):
        return [], []
    buckets, counts = _grams(text)
    grams, counts = model.grams[buckets], counts.astype(float)
    alone = counts @ np.log(grams)
    order = np.argsort(-_mixture(grams, counts, fit.rounds)[0], kind="stable")
    order = np.concatenate(([alone.argmax()], order[order != alone.argmax()]))
    chosen, shares, best = order[:1], np.ones(1), float(alone.max())
    step = fit.penalty * 0.5 * math.log(max(2.0, counts.sum()))
    for k in range(2, len(order) + 1):
        found, likelihood = _mixture(grams[:, order[:k]], counts, fit.rounds)
        if fit.worth * (likelihood - best) <= step:
            break
        chosen, shares, best = order[:k], found, likelihood
    ranked = np.argsort(-shares, kind="stable")
    return [model.names[chosen[i]] for i in ranked], [float(shares[i]) for i in ranked]


def languages(text: Column, model: Languages, fit: Fit = Fit()) -> Column:
    """``lang`` (the largest share; ``und`` for NULL or a text without letters), ``score`` (its
    share; 0 for ``und``), ``langs`` and ``shares`` (all that were chosen), as a struct."""

    def inferred(column: pa.Array) -> pa.Array:
        found = [infer(t, model, fit) for t in column.to_pylist()]
        return pa.StructArray.from_arrays(
            [
                pa.array([a[0] if a else UNDETERMINED for a, _ in found], pa.string()),
                pa.array([min(1.0, s[0]) if s else 0.0 for _, s in found], pa.float64()),
                pa.array([a for a, _ in found], pa.list_(pa.string())),
                pa.array([s for _, s in found], pa.list_(pa.float64())),
            ],
            names=["lang", "score", "langs", "shares"],
        )

    result = "lang string, score double, langs array<string>, shares array<double>"
    return F.arrow_udf(result)(sliced(inferred))(text)


def held_out(doc: Column) -> Column:
    """Rows not to learn from; a NULL id is none of them."""
    return F.coalesce(F.crc32(doc.cast("string")) % 4 == 2, F.lit(False))


def learn_languages(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = 2000,
    smoothing: float = 0.05,
) -> Languages:
    """Distributions of the languages that rows not held out name.

    About ``sample`` texts of each language are learnt from, chosen by a hash of the id; rows
    without a language or a text teach nothing. The result has a row for each bucket, so its
    size depends on the number of languages alone.
    """
    usable = docs.select(
        F.col(doc).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")
    ).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Languages([], np.zeros((BUCKETS, 0)))
    part = F.coalesce(
        *(F.when(F.col("lang") == name, F.lit(sample / n)) for name, n in sizes.items())
    )
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in chain.from_iterable(map(slices, batches)):
            for name, value in zip(*(c.to_pylist() for c in batch.columns)):
                buckets, counts = _grams(value)
                seen.setdefault(name, np.zeros(BUCKETS, np.int64))[buckets] += counts
        for name, counts in seen.items():
            held = np.flatnonzero(counts)
            yield pa.record_batch(
                [pa.array([name] * len(held)), pa.array(held, pa.int32()), pa.array(counts[held])],
                names=["lang", "bucket", "n"],
            )

    counted = (
        usable.where(place < part)
        .select("lang", "text")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))  # BUCKETS at most
        .collect()
    )
    names = sorted(sizes)
    table = np.zeros((BUCKETS, len(names)))
    for row in counted:
        for bucket, n in row.counts:
            table[bucket, names.index(row.lang)] = n
    table += smoothing
    return Languages(names, table / table.sum(axis=0))
