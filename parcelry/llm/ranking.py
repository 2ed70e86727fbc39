"""Ranked lexical search by scanning the documents.

An Aho-Corasick automaton holds the terms of all items, each guarded by boundaries on both sides,
and counts them in the text itself; the documents have no index. What a document has of each term
is kept, the frequencies over all documents follow from that, and then the terms' postings map
the counts to scores of the items. A task passes on only the best documents of each item.

Items are taken in blocks whose terms fit the memory of a task; every block scans all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.llm.text import slices
from parcelry.session import Staging

BEST = 10
#: Pairs of an item and one of its terms that a block holds: some 100 MB in a task.
MAX_POSTINGS = 500_000
_CELLS = 2_000_000  # numbers that a task scores at a time

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same in bytes: A-Z becomes lower case, separators become spaces.
_BYTES = bytes(
    c | 0x20 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 0x80 else 0x20
    for c in range(256)
)


def terms_of(text: Column) -> Column:
    """The terms of a text with repeats: runs of letters, digits and all beyond ASCII, A-Z in
    lower case; NULL has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(plain, _SEPARATORS), lambda w: w != "")


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id``, ``term`` and ``n``, how often the item has it. Rows with one id are one item,
    NULL being an id as well; items without terms have no row."""
    return (
        items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term"))
        .groupBy("item_id", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass(frozen=True)
class Postings:
    """The terms of a block of items; per pair of item and term, in order of the items, which
    they are and how often the item has the term."""

    terms: list[str]
    items: list[int | None]
    starts: np.ndarray  # where the pairs of each item begin
    term: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, str, int]]) -> "Postings":
        terms = sorted({term for _, term, _ in rows})
        number = {term: i for i, term in enumerate(terms)}
        ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        items, starts = [], []
        for at, (item, _, _) in enumerate(ordered):
            if not items or items[-1] != item:
                items.append(item)
                starts.append(at)
        return Postings(
            terms,
            items,
            np.array(starts, np.int64),
            np.array([number[t] for _, t, _ in ordered], np.int64),
            np.array([n for _, _, n in ordered], np.int64),
        )

    def automaton(self) -> ahocorasick.Automaton:
        """Finds the terms in the bytes of a text, each byte being one character."""
        found = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            found.add_word(f" {term.encode().decode('latin-1')} ", i)
        found.make_automaton()
        return found


def count_terms(text: str, automaton: ahocorasick.Automaton) -> tuple[int, Counter]:
    """How many terms the text has, and how often each of the automaton's."""
    data = b" %b " % text.encode().translate(_BYTES)
    # Each hit begins and ends with a boundary, so it is a whole term; hits share boundaries.
    return len(data.split()), Counter(map(itemgetter(1), automaton.iter(data.decode("latin-1"))))


_COUNTED = "doc_id long, n long, terms array<int>, counts array<long>"


def counted(docs: DataFrame, postings: Postings) -> DataFrame:
    """What the documents that have terms have of those of the postings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = postings.automaton()
        for batch in chain.from_iterable(map(slices, batches)):
            ids, sizes, terms, counts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, seen = count_terms(text or "", automaton)
                if size:
                    ids.append(doc)
                    sizes.append(size)
                    terms.append(list(seen.keys()))
                    counts.append(list(seen.values()))
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, _COUNTED)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Best:
    """The best documents of every item so far; ids that are NULL come after all others."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.scores = np.zeros((items, best), np.int64)
        self.ids = np.zeros((items, best), np.int64)
        self.nulls = np.ones((items, best), np.int8)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """``scores`` has a row for each document and a column for each item."""
        touched = np.flatnonzero(
            (scores.max(axis=0, initial=0) >= self.scores[:, -1]) & scores.any(axis=0)
        )
        if not len(touched):
            return
        shape = len(touched), len(ids)
        all_scores = np.concatenate([self.scores[touched], scores.T[touched]], axis=1)
        all_ids = np.concatenate([self.ids[touched], np.broadcast_to(ids, shape)], axis=1)
        all_nulls = np.concatenate([self.nulls[touched], np.broadcast_to(nulls, shape)], axis=1)
        order = np.lexsort((all_ids, all_nulls, -all_scores), axis=1)[:, : self.best]
        self.scores[touched] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[touched] = np.take_along_axis(all_ids, order, axis=1)
        self.nulls[touched] = np.take_along_axis(all_nulls, order, axis=1)

    def rows(self, items: list[int | None]) -> pa.RecordBatch:
        at, place = np.nonzero(self.scores)
        ids = self.ids[at, place]
        return pa.record_batch(
            [
                pa.array([items[i] for i in at], pa.int64()),
                pa.array(ids, mask=self.nulls[at, place] == 1),
                pa.array(self.scores[at, place]),
            ],
            names=["item_id", "doc_id", "score"],
        )


def best_of_tasks(
    found: DataFrame, postings: Postings, weights: np.ndarray, n_docs: int, n_terms: int, best: int
) -> DataFrame:
    """``item_id``, ``doc_id`` and ``score`` of each task's best documents of every item."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Best(len(postings.items), best)
        step = max(1, _CELLS // max(len(postings.term), 1))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                sizes = part.column(1).to_pylist()
                # Python's integers: the product may be beyond 64 bits.
                m = np.array([25 + 75 * n * n_docs // n_terms for n in sizes], np.int64)
                terms = part.column(2)
                lengths = np.diff(terms.offsets.to_numpy())
                rows = np.repeat(np.arange(len(part)), lengths)
                tf = part.column(3).flatten().to_numpy()
                values = np.zeros((len(part), len(postings.terms)), np.int64)
                term = terms.flatten().to_numpy()
                values[rows, term] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[rows]))
                scores = np.add.reduceat(values[:, postings.term] * postings.n, postings.starts, axis=1)
                ids = part.column(0)
                top.add(
                    scores,
                    ids.fill_null(0).to_numpy(),
                    ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8),
                )
        yield top.rows(postings.items)

    return found.mapInArrow(score, "item_id long, doc_id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    staging: Staging,
    best: int = BEST,
    max_postings: int = MAX_POSTINGS,
) -> DataFrame:
    """The ``best`` documents of every item with their ``rank`` and ``score``.

    Equal scores are ranked by the id, a NULL id last; documents that score nothing are left out.
    Every row of ``docs`` is a document, repeated ones too. Rows of ``items`` with one id are one
    item. NULL texts and texts without terms match nothing, and empty tables give no rows.

    A block of items holds about ``max_postings`` pairs of item and term, but always whole items.
    The driver holds the terms of one block at a time, and each task sends on ``best`` rows of an
    item at most, so no item and no frequent term gathers rows in one place.
    """
    pairs = staging.write(item_terms(items))
    blocks = max(1, -(-pairs.rows // max_postings))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    parts = []
    for number in range(blocks):
        rows = [tuple(r) for r in pairs.frame.where(block == number).collect()]
        if not rows:
            continue
        postings = Postings.of(rows)
        found = staging.write(counted(docs, postings)).frame
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        frequencies = (
            found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        )  # a row for each term of the block at most
        weights = np.zeros(len(postings.terms), np.int64)
        for r in frequencies:
            weights[r.term] = weight(n_docs, r["count"])
        parts.append(best_of_tasks(found, postings, weights, n_docs, n_terms, best))
    if not parts:
        none = "item_id long, rank int, doc_id long, score long"
        return docs.sparkSession.createDataFrame([], none)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        reduce(DataFrame.unionAll, parts)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= best)
        .select("item_id", "rank", "doc_id", "score")
    )
