"""Quality rules by distribution divergence.

A document is compared with references of every language: a histogram of character classes
and a histogram of the language's commonest words, by Jensen-Shannon distance. It passes if
some language is near in both. Plain rules on length and repetition come first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.llm.text import sliced, slices

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: Classes of bytes: lower, upper, space, digit or sentence mark, other ASCII, start of a longer
#: character; the rest of a longer character is left out. Digits have no class of their own, as
#: one number in a short text would then weigh as much as a text of symbols.
N_CLASSES = 6
_CLASS = np.full(256, 4, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[list(SPACES.encode())] = 2
_CLASS[list(b"0123456789.,;:?!'\"()-")] = 3
_CLASS[0x80:0xC0] = N_CLASSES
_CLASS[0xC0:] = 5

#: Only letters matter for the common words; the case does not.
_TO_LETTERS = bytes(
    c | 0x20 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 0x20 for c in range(256)
)


@dataclass(frozen=True)
class Limits:
    """What the rules allow.

    ``class_distance`` and ``word_distance`` hold for long texts. A short text strays by chance:
    with n samples over k bins the divergence expected is about (k - 1) / (8 n ln 2) bits, and
    ``chance`` times that is allowed in addition. However short, a text has to be nearer to the
    common words than ``of_none`` times the distance of a text that has none of them. Texts
    under ``min_chars`` or ``min_words`` have no distance taken.
    """

    min_words: int = 50
    max_repeated: float = 0.5
    min_chars: int = 100
    class_distance: float = 0.17
    word_distance: float = 0.3
    of_none: float = 0.95
    chance: float = 2.0


@dataclass(frozen=True)
class References:
    """By language: the shares of character classes, the common words and their shares."""

    languages: list[str]
    classes: np.ndarray
    words: list[dict[bytes, int]]
    shares: list[np.ndarray]


def without_common(shares: np.ndarray) -> float:
    """The word distance of a text that has none of the common words."""
    return js_distance(np.append(np.zeros(len(shares) - 1), 1.0), shares)


def _letters(data: bytes) -> list[bytes]:
    return data.translate(_TO_LETTERS).split()


def _class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


def fit_references(
    docs: DataFrame, text: str = "text", lang: str = "lang", common: int = 64, held: int = 200_000
) -> References:
    """References from all texts with a language.

    The share of a character class is the median over the documents, as junk would shift a
    mean. Words are counted exactly, whatever task they are in: a task passes on what it has
    counted whenever it holds ``held`` distinct words, and the parts are added. NULL texts and languages are left out; no rows give no
    references, and then only the plain rules decide.
    """

    def class_shares(column: pa.Array) -> pa.Array:
        found = [_class_counts(t.encode()) for t in column.to_pylist()]
        return pa.array([(x / x.sum()).tolist() if x.any() else None for x in found], _SHARES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def passed_on() -> pa.RecordBatch:
            found = [(name, w, k) for name, words in seen.items() for w, k in words.items()]
            seen.clear()
            columns = list(zip(*found)) or [(), (), ()]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _COUNTS)], _COUNTS)

        for batch in chain.from_iterable(map(slices, batches)):
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = seen.setdefault(name, Counter())
                words = _letters(value.encode())
                counts.update(words)
                counts[None] += len(words)
                if sum(map(len, seen.values())) > held:
                    yield passed_on()
        yield passed_on()

    texts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    medians = (
        texts.select("lang", F.arrow_udf("array<double>")(sliced(class_shares))("text").alias("shares"))
        .groupBy("lang")
        .agg(*(F.percentile_approx(F.col("shares")[i], 0.5, 1000) for i in range(N_CLASSES)))
        .orderBy("lang")
        .collect()  # one row for a language
    )
    counted = (
        texts.mapInArrow(count, "lang string, word binary, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.col("word").isNotNull(), F.desc("n"), "word")
    kept = (
        counted.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= common + 1)
        .collect()  # common + 1 rows for a language, the total first
    )
    classes, words, shares = [], [], []
    for row in medians:
        found = np.array([v or 0.0 for v in row[1:]])
        own = sorted((r for r in kept if r.lang == row[0]), key=lambda r: r.place)
        total = max(own[0].n, 1)
        part = np.array([r.n / total for r in own[1:]])
        classes.append(found / max(found.sum(), 1e-9))
        words.append({bytes(r.word): i for i, r in enumerate(own[1:])})
        shares.append(np.append(part, max(0.0, 1 - part.sum())))
    return References([r[0] for r in medians], np.array(classes), words, shares)


_SHARES = pa.list_(pa.float64())
_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, from 0 to 1 (base 2)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == n:
        return 0
    starts = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : k + n] |= starts
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def judge(text: str, references: References, limits: Limits) -> tuple:
    data = text.encode()
    words = data.split()  # the white space of ASCII
    n = len(words)
    repeated = repeated_words(words)
    failed = n < limits.min_words or repeated > limits.max_repeated * n
    by_class = by_word = None
    nearest = None
    if references.languages and not failed:
        found = _class_counts(data)
        total = int(found.sum())
        if total >= limits.min_chars:
            by_class = [js_distance(found / total, q) for q in references.classes]
        letters = _letters(data)
        if len(letters) >= limits.min_words:
            seen = Counter(letters)
            by_word = []
            for common, q in zip(references.words, references.shares):
                p = np.zeros(len(q))
                for w, i in common.items():
                    p[i] = seen.get(w, 0)
                p[-1] = len(letters) - p.sum()
                by_word.append(js_distance(p / len(letters), q))
        excess = np.full(len(references.languages), -1.0)
        if by_class is not None:
            slack = limits.chance * (N_CLASSES - 1) / (8 * total * np.log(2))
            excess = np.maximum(excess, np.array(by_class) - np.sqrt(limits.class_distance**2 + slack))
        if by_word is not None:
            k = np.array([len(q) for q in references.shares])
            slack = limits.chance * (k - 1) / (8 * len(letters) * np.log(2))
            most = limits.of_none * np.array([without_common(q) for q in references.shares])
            allowed = np.minimum(np.sqrt(limits.word_distance**2 + slack), most)
            excess = np.maximum(excess, np.array(by_word) - allowed)
        nearest = int(np.argmin(excess))
    kept = not failed and (nearest is None or excess[nearest] <= 0)
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        repeated_lines(text),
        repeated,
        failed,
        kept,
        None if nearest is None else references.languages[nearest],
        None if by_class is None else by_class[nearest],
        None if by_word is None else by_word[nearest],
    )


_FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "nearest_lang": pa.string(),
    "class_distance": pa.float64(),
    "word_distance": pa.float64(),
}
_RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, nearest_lang string, class_distance double, "
    "word_distance double"
)


def quality(text: Column, references: References, limits: Limits = Limits()) -> Column:
    """Counts, the plain rules' verdict and the divergence verdict of a text, as a struct.

    Words are what stands between white space of ASCII. NULL counts as a text without words
    and fails, like the empty text, for its length. The references are a parameter of bounded
    size (languages times common words) and go along with the function.
    """

    def judged(column: pa.Array) -> pa.Array:
        found = [judge(t or "", references, limits) for t in column.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*found), _FIELDS.values())], names=list(_FIELDS)
        )

    return F.arrow_udf(_RESULT)(sliced(judged))(text)
