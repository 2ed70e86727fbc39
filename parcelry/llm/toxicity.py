"""Toxicity by a weighted lexicon.

Texts are folded: look-alike letters, accents, digits and signs that stand for letters become
plain letters. An Aho-Corasick automaton finds the lexicon's entries, each the beginning of a
word, and the phrases in which an entry is harmless; hits inside such a phrase do not count.
The weights of the hits are set against the length of the text.

The lexicon is learnt from labelled texts: beginnings of words that are in far more toxic than
clean texts.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.text import sliced, slices, spaced_words
from parcelry.session import Staging

#: Signs and letters of other scripts that look like Latin letters. i, l and 1 are one letter.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "l": "i", "|": "i", "ı": "i", "ø": "o", "ł": "i", "đ": "d",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ѡ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}

#: In these an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pathetic fallacy")

LENGTHS = range(4, 11)
THRESHOLD = 0.7


class _Fold(dict):
    """For ``str.translate``: what a character becomes; found out once for each character."""

    def __missing__(self, code: int) -> str:
        plain = unicodedata.normalize("NFKD", chr(code))[:1].lower()
        plain = LOOKALIKES.get(plain, plain)
        if not plain.isalpha():
            # Marks and invisible characters inside a word must not cut it.
            plain = "" if unicodedata.category(chr(code)) in ("Mn", "Cf") else " "
        self[code] = plain
        return plain


_FOLD = _Fold()


def fold(text: str) -> list[str]:
    """The folded words."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Lexicon:
    """Beginnings of folded words with weights, and folded phrases in which they are harmless."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()

    def automaton(self) -> ahocorasick.Automaton:
        """Entries with their weight, exceptions with weight None; both with their length."""
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(f" {entry}", (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 1, None))
        found.make_automaton()
        return found


def _evidence(words: list[str], automaton: ahocorasick.Automaton) -> tuple[float, int]:
    """The weight of all hits outside of exceptions, and their number."""
    if not len(automaton) or not words:
        return 0.0, 0
    hits, harmless = {}, []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        if weight is None:
            harmless.append((end - size, end))
        else:
            start = end - size  # where the word begins: one hit for a word, the heaviest
            hits[start] = max(weight, hits.get(start, 0.0))
    if harmless:
        hits = {
            at: w for at, w in hits.items() if not any(a <= at < b for a, b in harmless)
        }
    return sum(hits.values()), len(hits)


def _score(weight: float, n_words: int) -> float:
    """From 0 to 1. Twice the words take off less than half: a long text is toxic for a few
    words, but needs more of them than a short one."""
    return 1 - math.exp(-1.2 * weight / math.log2(2 + n_words / 100))


def toxicity(text: Column, lexicon: Lexicon) -> Column:
    """``score`` (0 to 1), ``n_hits`` and ``predicted`` (score of 0.7 or more) as a struct.

    NULL, empty texts and texts without letters score 0.
    """

    @F.arrow_udf("score double, n_hits long, predicted int")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for batch in chain.from_iterable(map(slices, batches)):
            scores, hits = [], []
            for value in batch.to_pylist():
                words = fold(value or "")
                weight, n = _evidence(words, automaton)
                scores.append(_score(weight, len(words)))
                hits.append(n)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(scores, pa.float64()),
                    pa.array(hits, pa.int64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                ],
                names=["score", "n_hits", "predicted"],
            )

    return scored(text)


def held_out(doc: Column) -> Column:
    """Rows not to learn from; a NULL id is none of them."""
    return F.coalesce(F.crc32(doc.cast("string")) % 3 == 1, F.lit(False))


def _marks(column: pa.Array) -> pa.Array:
    """The least hash of three words in a row, which near copies mostly share."""
    found = []
    for value in column.to_pylist():
        words = spaced_words(value)
        runs = (b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))
        found.append(min(map(xxhash.xxh64_intdigest, runs)) >> 1)
    return pa.array(found, pa.int64())


def _beginnings(value: str) -> set[str]:
    words = set(fold(value))
    return {w[:n] for w in words for n in LENGTHS if len(w) >= n}


def _counts(texts: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """In how many texts each beginning of a word is, of those wanted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in chain.from_iterable(map(slices, batches)):
            for value in batch.column(0).to_pylist():
                found = _beginnings(value)
                seen.update(found if wanted is None else found & wanted)
        yield pa.record_batch(
            [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())],
            names=["entry", "n"],
        )

    return (
        texts.select("text")
        .mapInArrow(count, "entry string, n long")
        .groupBy("entry")
        .agg(F.sum("n").alias("n"))
    )


def _likelihood_ratio(toxic: int, clean: int, share: float) -> float:
    """Twice the log likelihood that the texts gain by their own share of toxic ones."""
    n = toxic + clean
    gain = sum(
        k * math.log(k / n / p) for k, p in ((toxic, share), (clean, 1 - share)) if k
    )
    return 2 * gain


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    staging: Staging,
    sample: int = 6000,
    least: int = 3,
    odds: float = 3.5,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """The lexicon of labelled texts.

    At most ``sample`` toxic and four times as many clean texts are learnt from, chosen by a hash
    of their id, which also bounds the sizes of all that is counted. Of near copies, whose every
    word would seem to stand out, that of the smallest id counts (of rows with one id, the text
    that sorts first), whatever the order of the rows. An entry is in ``least`` toxic texts or more,
    its log odds are at least ``odds``, and it stands out by more than the chance that some
    entry of so many does. Of entries that begin alike the one that tells most stays, and of
    several equal in that the longest. Rows held out, and labels or texts that are NULL, are not learnt from; an id with
    several labels counts as toxic if one of them is. Without rows the lexicon is empty.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {1: sample, 0: 4 * sample}
    labelled = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))

    def some(label: int) -> DataFrame:
        # About twice as many by their hash, so that few are sorted, then as many as are wanted.
        part = min(1.0, 2 * sizes[label] / labelled.get(label, 1))
        near = usable.where((F.col("toxic") == label) & (place < int(part * (1 << 40))))
        return near.orderBy(place, "doc_id").limit(sizes[label])

    chosen = [some(label) for label in (1, 0)]
    texts = staging.write(
        docs.select("doc_id", "text")
        .where("text IS NOT NULL")
        .join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")  # of bounded size
        .select("toxic", "doc_id", "text", F.arrow_udf("long")(sliced(_marks))("text").alias("mark"))
        .groupBy("toxic", "mark")
        .agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"))
    ).frame
    n_of = {r.toxic: r[1] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n_of.get(1, 0), n_of.get(0, 0)
    if not n_toxic:
        return Lexicon({}, frozenset())
    toxic = {
        r.entry: r.n for r in _counts(texts.where("toxic = 1")).where(F.col("n") >= least).collect()
    }
    clean = {r.entry: r.n for r in _counts(texts.where("toxic = 0"), set(toxic)).collect()}
    share = n_toxic / (n_toxic + n_clean)
    enough = 2 * math.log(max(len(toxic), 2))
    found = {}
    for entry, t in toxic.items():
        c = clean.get(entry, 0)
        weight = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        gain = _likelihood_ratio(t, c, share) if n_clean else 2.0 * t
        if weight >= odds and (not n_clean or gain >= enough):
            found[entry] = (weight, gain)
    weights: dict[str, float] = {}
    for entry in sorted(found, key=lambda e: (-found[e][1], -len(e), e)):
        if not any(entry.startswith(x) or x.startswith(entry) for x in weights):
            weights[entry] = found[entry][0]
    harmless = {" ".join(fold(x)) for x in exceptions}
    return Lexicon(weights, frozenset(harmless))
