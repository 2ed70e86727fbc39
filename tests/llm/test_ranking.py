"""Ranked search against a plain version."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from parcelry.llm import ranking
from parcelry.llm.oracle import oracle_sql
from parcelry.llm.queries import op12_search
from parcelry.session import Staging
from parcelry_checks.compare import difference, oracle_connection

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def _plain(docs, items, best=10):
    words = [(doc, Counter(found), len(found)) for doc, text in docs if (found := _terms(text))]
    n_docs, n_terms = len(words), sum(n for *_, n in words)
    df = Counter(term for _, seen, _ in words for term in seen)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(_terms(text))
    result = []
    for item, terms in wanted.items():
        scored = []
        for doc, seen, n in words:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = 0
            for term, times in terms.items():
                if tf := seen[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc, score))
        for rank, (*_, doc, score) in enumerate(sorted(scored)[:best], 1):
            result.append((item, rank, doc, score))
    return sorted(result, key=repr)


ITEMS = [
    (1, "The quick fox, the QUICK fox"),
    (2, "Straße über Größe"),
    (3, None),
    (4, "!!!"),
    (5, "a"),
    (6, "nowhere-to-be-found"),
    (2, "quick"),  # the same item
    (None, "lazy dog"),
]


def _docs():
    docs = [
        (1, "the quick brown fox"),
        (2, "THE QUICK BROWN FOX"),
        (2, "the quick brown fox"),
        (3, "a a a a a b a"),
        (4, None),
        (5, " ... "),
        (6, "straße ÜBER über größe"),
        (None, "lazy dog lazy"),
        (None, "lazy dog lazy"),
        (7, "quickfox thefox dog"),
        (8, "the\x00quick{fox}the_quick-fox\n1a"),
    ]
    docs += [(100 + i, f"fox number {i} " + "the " * (i % 7)) for i in range(300)]
    docs += [(1000 + i, "the quick fox of many copies") for i in range(400)]  # ties
    return docs


@pytest.mark.parametrize("max_postings", [ranking.MAX_POSTINGS, 3])
@pytest.mark.parametrize("cells", [ranking._CELLS, 40])
def test_equals_plain_version(spark, monkeypatch, max_postings, cells):
    monkeypatch.setattr(ranking, "_CELLS", cells)
    docs = spark.createDataFrame(_docs(), "doc_id long, text string").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    with Staging(spark) as staging:
        found = ranking.search(docs, items, staging, max_postings=max_postings).collect()
    assert sorted(map(tuple, found), key=repr) == _plain(_docs(), ITEMS)


def test_terms_are_whole_and_overlap():
    postings = ranking.Postings.of([(1, "a", 1), (1, "b", 1), (1, "ü", 1)])
    n, seen = ranking.count_terms("A b,a;a ab ba aü ü\x7fB", postings.automaton())
    assert n == 9
    assert {postings.terms[i]: k for i, k in seen.items()} == {"a": 3, "b": 2, "ü": 1}


def test_very_long_text():
    postings = ranking.Postings.of([(1, "all", 1)])
    assert ranking.count_terms("all rights " * 400_000, postings.automaton()) == (800_000, {0: 400_000})


def test_products_beyond_64_bits(spark):
    # 75 * n * N of a very long text in a very large corpus.
    schema = "doc_id long, n long, terms array<int>, counts array<long>"
    found = spark.createDataFrame([(1, 10**10, [0], [10**6])], schema)
    postings = ranking.Postings.of([(9, "a", 2)])
    row = ranking.best_of_tasks(found, postings, np.array([7]), 10**10, 10**13, 10).collect()
    m = 25 + 75 * 10**10 * 10**10 // 10**13
    assert [tuple(r) for r in row] == [(9, 1, 14 * (10**15 // (10**9 + 8 * m)))]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    sql = oracle_sql()["op12_search"]
    assert difference(op12_search(spark, folder), oracle_connection(folder), sql) is None
