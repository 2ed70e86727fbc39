"""Quality by histogram gradient-boosted trees over statistics of the text.

A text becomes a row of statistics: shares of character classes, lengths of words and lines,
repetition, evenness of the bytes. Trees are grown on histograms of binned statistics; all of
them lie in flat arrays, through which numpy moves many rows and trees at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.text import sliced

THRESHOLD = 0.3
#: Labelled documents that are learnt from, at most.
SAMPLE = 20_000

SPACES = " \t\n\v\f\r"
_KINDS = ("lower", "upper", "digit", "space", "stop", "comma", "bracket", "symbol", "control", "beyond")
_REST = len(_KINDS)  # further bytes of a longer character
_KIND = np.full(256, _KINDS.index("symbol"), np.uint8)
_KIND[:0x20] = _KIND[0x7F] = _KINDS.index("control")
_KIND[ord("a") : ord("z") + 1] = _KINDS.index("lower")
_KIND[ord("A") : ord("Z") + 1] = _KINDS.index("upper")
_KIND[ord("0") : ord("9") + 1] = _KINDS.index("digit")
_KIND[list(SPACES.encode())] = _KINDS.index("space")
_KIND[list(b".!?")] = _KINDS.index("stop")
_KIND[list(b",;:'\"-")] = _KINDS.index("comma")
_KIND[list(b"()[]{}")] = _KINDS.index("bracket")
_KIND[0x80:0xC0] = _REST
_KIND[0xC0:] = _KINDS.index("beyond")
_LETTER = np.isin(_KIND, [_KINDS.index(k) for k in ("lower", "upper", "beyond")]) | (_KIND == _REST)

STATISTICS = (
    *_KINDS,
    "characters",
    "evenness",
    "words",
    "word_length",
    "word_spread",
    "longest_word",
    "capitalised",
    "all_capitals",
    "without_letter",
    "ends_in_stop",
    "ends_in_symbol",
    "distinct_words",
    "commonest_word",
    "distinct_pairs",
    "lines",
    "line_length",
    "line_spread",
    "repeated_lines",
    "lines_ending_in_stop",
    "words_a_line",
)

#: Bytes of a text whose kinds are counted at a time.
_PIECE = 1 << 20


def _byte_counts(data: np.ndarray) -> np.ndarray:
    counts = np.zeros(256, np.int64)
    for at in range(0, len(data), _PIECE):
        counts += np.bincount(data[at : at + _PIECE], minlength=256)
    return counts


def statistics(text: str) -> list[float]:
    """The values named in ``STATISTICS``; shares that have no base are 0."""
    data = text.encode()
    view = np.frombuffer(data, np.uint8)
    counts = _byte_counts(view)
    kinds = np.bincount(_KIND, counts, minlength=_REST + 1)
    chars = max(int(kinds[:_REST].sum()), 1)
    shares = counts[counts > 0] / max(len(data), 1)
    found = [*(kinds[:_REST] / chars), np.log1p(len(text)), -float((shares * np.log2(shares)).sum())]

    words = data.split()
    n = len(words)
    if not n:
        found += [0.0] * 12
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        packed = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        letters = np.add.reduceat(_LETTER[packed], starts, dtype=np.int64)
        capitals = np.add.reduceat(_KIND[packed] == _KINDS.index("upper"), starts, dtype=np.int64)
        first, last = _KIND[packed[starts]], _KIND[packed[ends - 1]]
        seen = Counter(words)
        found += [
            np.log1p(n),
            lengths.mean(),
            lengths.std(),
            np.log1p(lengths.max()),
            (first == _KINDS.index("upper")).mean(),
            ((capitals == letters) & (letters > 1)).mean(),
            (letters == 0).mean(),
            (last == _KINDS.index("stop")).mean(),
            (last == _KINDS.index("symbol")).mean(),
            len(seen) / n,
            max(seen.values()) / n,
            len(set(zip(words, words[1:]))) / max(n - 1, 1),
        ]
    lines = [x for x in data.split(b"\n") if x.strip()]
    if not lines:
        return [float(x) for x in found + [0.0] * 6]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    last = _KIND[[x.rstrip()[-1] for x in lines]]
    found += [
        np.log1p(len(lines)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        1 - len(set(lines)) / len(lines),
        (last == _KINDS.index("stop")).mean(),
        np.log1p(n / len(lines)),
    ]
    return [float(x) for x in found]


_ROW = pa.list_(pa.float64())


def text_statistics(text: Column) -> Column:
    """The statistics of a text as an array; NULL counts as the empty text."""

    def measured(column: pa.Array) -> pa.Array:
        return pa.array([statistics(t or "") for t in column.to_pylist()], _ROW)

    return F.arrow_udf("array<double>")(sliced(measured))(text)


@dataclass(frozen=True)
class Trees:
    """All trees one behind the other: node i asks whether ``feature[i]`` is at most
    ``threshold[i]`` and goes to ``left[i]`` or ``right[i]``; a leaf goes to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """The log odds of each row."""
        at = np.tile(self.roots, (len(rows), 1))
        line = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            below = rows[line, self.feature[at]] <= self.threshold[at]
            at = np.where(below, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return _logistic(self.margins(rows))


def _logistic(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -40, 40)))


@dataclass(frozen=True)
class Growth:
    """How trees are grown."""

    rounds: int = 120
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    least: int = 20  # rows of a leaf
    ridge: float = 1.0
    gain: float = 1e-6  # of a split


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of the bins but the last, between values that occur."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="lower"))
    return (values[:-1] + values[1:]) / 2


def _grow(binned, gradients, hessians, cuts, growth: Growth, width: int):
    """One tree as lists of nodes, and the leaf of every row."""
    n, n_features = binned.shape
    feature, threshold, left, right, value = [0], [np.inf], [0], [0], [0.0]
    node = np.zeros(n, np.int64)  # of each row
    level = [0]
    offsets = np.arange(n_features) * width
    valid = np.arange(width)[None, :] < np.array([len(c) for c in cuts])[:, None]
    for depth in range(growth.depth + 1):
        index = np.full(len(feature), -1)
        index[level] = np.arange(len(level))
        rows = np.flatnonzero(index[node] >= 0)
        slot = index[node[rows]]
        g, h = gradients[rows], hessians[rows]
        total_g = np.bincount(slot, g, len(level))
        total_h = np.bincount(slot, h, len(level))
        for i, name in enumerate(level):
            value[name] = -growth.rate * total_g[i] / (total_h[i] + growth.ridge)
        if depth == growth.depth:
            break
        # Histograms of all nodes of the level and all features at once.
        cell = (slot[:, None] * (n_features * width) + offsets + binned[rows]).ravel()
        shape = len(level), n_features, width
        size = len(level) * n_features * width
        sums = [
            np.bincount(cell, np.repeat(v, n_features), size).reshape(shape).cumsum(axis=2)
            for v in (g, h)
        ]
        counts = np.bincount(cell, minlength=size).reshape(shape).cumsum(axis=2)
        g_left, h_left = sums
        g_right, h_right = total_g[:, None, None] - g_left, total_h[:, None, None] - h_left
        gains = (
            g_left**2 / (h_left + growth.ridge)
            + g_right**2 / (h_right + growth.ridge)
            - (total_g**2 / (total_h + growth.ridge))[:, None, None]
        )
        allowed = (
            valid[None] & (counts >= growth.least) & (counts[:, :, -1:] - counts >= growth.least)
        )
        gains = np.where(allowed, gains, -np.inf).reshape(len(level), -1)
        chosen = gains.argmax(axis=1)  # of equal ones the first feature and the lowest cut
        following = []
        for i, name in enumerate(level):
            if gains[i, chosen[i]] <= growth.gain:
                continue
            f, b = divmod(int(chosen[i]), width)
            feature[name], threshold[name] = f, cuts[f][b]
            left[name], right[name] = len(feature), len(feature) + 1
            following += [len(feature), len(feature) + 1]
            for child in following[-2:]:
                feature.append(0)
                threshold.append(np.inf)
                left.append(child)
                right.append(child)
                value.append(0.0)
            mine = rows[slot == i]
            node[mine] = np.where(binned[mine, f] <= b, left[name], right[name])
        level = following
        if not level:
            break
    for name in range(len(feature)):
        if left[name] != name:
            value[name] = 0.0
    return feature, threshold, left, right, value, node


def fit_trees(rows: np.ndarray, labels: np.ndarray, growth: Growth = Growth()) -> Trees:
    """Boosted trees for the log odds of label 1. The order of the rows does not matter.

    Without rows, or with rows of one label, there are no trees and the score is one for all: the
    share of label 1 with one row of either label added.
    """
    n, ones = len(labels), float(labels.sum())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    parts: list[list] = [[], [], [], [], []]
    roots: list[int] = []
    if 0 < ones < n:
        order = np.lexsort((labels, *rows.T))
        rows, labels = rows[order], labels[order].astype(float)
        cuts = [_cuts(column, growth.bins) for column in rows.T]
        width = max(map(len, cuts)) + 1
        binned = np.stack([np.searchsorted(c, x, "left") for c, x in zip(cuts, rows.T)], axis=1)
        margins = np.full(n, base)
        for _ in range(growth.rounds):
            p = _logistic(margins)
            *tree, leaf = _grow(binned, p - labels, p * (1 - p), cuts, growth, width)
            margins += np.array(tree[4])[leaf]
            at = len(parts[0])
            roots.append(at)
            for part, own in zip(parts, tree):
                part += own
            for part in parts[2:4]:
                part[at:] = [x + at for x in part[at:]]
    feature, threshold, left, right, value = parts
    return Trees(
        np.array(feature, np.int64),
        np.array(threshold, float),
        np.array(left, np.int64),
        np.array(right, np.int64),
        np.array(value, float),
        np.array(roots, np.int64),
        growth.depth,
        base,
    )


def held_out(doc: Column) -> Column:
    """Rows not to learn from; a NULL id is none of them."""
    return F.coalesce(F.crc32(doc.cast("string")) % 5 == 0, F.lit(False))


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``label`` and ``stats`` of at most ``sample`` labelled documents, chosen by a hash of the id.

    Rows held out and NULL labels are left out. An id with several labels has the greatest; of
    several texts with one id the one whose statistics are smallest counts.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    usable = usable.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    # About twice as many by their hash, so that few are sorted, then as many as are wanted.
    part = min(1.0, 2 * sample / max(usable.count(), 1))
    chosen = usable.where(place < int(part * (1 << 40))).orderBy(place, "doc_id").limit(sample)
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # of bounded size
        .select("doc_id", "label", text_statistics(F.col("text")).alias("stats"))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"), F.min("stats").alias("stats"))
        .select("label", "stats")
    )


def learn_quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, growth: Growth = Growth()
) -> Trees:
    """Trees from labelled documents; the driver holds the statistics of ``sample`` at most."""
    found = labelled_statistics(docs, labels, sample).toArrow()
    stats = found.column("stats").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    wanted = found.column("label").to_numpy()
    return fit_trees(stats.reshape(-1, len(STATISTICS)), (wanted > 0).astype(np.int64), growth)


def quality_score(text: Column, trees: Trees) -> Column:
    """``score`` (0 to 1) and ``predicted`` (1 if the score is 0.3 or more) as a struct.

    NULL and empty texts are scored by their statistics like any other; a text's words are held
    in memory as a whole, and it is judged as a whole.
    """

    def scored(column: pa.Array) -> pa.Array:
        rows = np.array([statistics(t or "") for t in column.to_pylist()])
        scores = trees.scores(rows.reshape(-1, len(STATISTICS)))
        return pa.StructArray.from_arrays(
            [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
            names=["score", "predicted"],
        )

    return F.arrow_udf("score double, predicted int")(sliced(scored))(text)
