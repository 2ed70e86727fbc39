import random
import re

import pytest
from pyspark.sql import functions as F

from parcelry.llm import decontaminate as d


def _words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _brute(docs, items):
    windows = []
    for name, text in items:
        words = _words(text)
        n = min(10, len(words))
        windows += [(name, words[i : i + n]) for i in range(len(words) - n + 1) if n]
    found = {}
    for doc, text in docs:
        words, hit, names = _words(text), set(), set()
        for name, window in windows:
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    names.add(str(name))
        found[doc] = (len(words), len(hit), sorted(names))
    return found


@pytest.mark.parametrize("limit", [d.MAX_BROADCAST_BYTES, 300])
def test_against_brute_force(spark, limit):
    rng = random.Random(5)
    vocabulary = ["a", "b", "É", "x1"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 3, 9, 10, 14]))) for i in range(8)] + [(99, "!"), (98, None)]
    items = [x for x in items if len(_words(x[1])) != 1] + [(7, "zz"), (12, "zz")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, f"Begin {t} end") for i, t in items] + [(200, None), (201, "ZZ zz")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    parts = d.window_parts(d.benchmark_windows(benchmark), limit)
    assert len(parts) > 1 or limit > 300
    frame = d.with_hits(spark.createDataFrame(docs, "doc_id long, text string"), parts)
    found = {
        r.doc_id: (r.hits.n_words, r.n_hit, r.hits["items"])
        for r in frame.withColumn("n_hit", d.hit_words(F.col("hits.spans"))).collect()
    }
    assert found == _brute(docs, items)


def test_spans_are_removed(spark):
    rows = [("Keep, THE Leaked-words: here.", [(1, 3)]), ("all", [(0, 1)]), ("none", []), (None, [])]
    frame = spark.createDataFrame(rows, "text string, spans array<struct<start:int,n:int>>")
    cleaned = [r[0] for r in frame.select(d.without_spans(F.col("text"), F.col("spans"))).collect()]
    assert cleaned == ["Keep,  -: here.", "", "none", None]


def test_a_collision_is_no_hit():
    part = d.Windows([("a b", ["1"])])
    ids, by_length = part._index
    (hashes, known) = by_length[2]
    known[int(hashes[0])][0] = ([b"a", b"c"], ["1"])
    assert part.find([b"a", b"b"]) == ([], set())
