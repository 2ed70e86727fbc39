"""All queries and the pipeline over tables of odd rows, and over empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelry.llm import queries as llm

EMPTY = hashlib.sha256(b"").hexdigest()
LONG = "The quick brown fox and the lazy dog walk. " * 4000
DOCS = [
    (1, "A plain text of some words.", "en", "s"),
    (1, "A plain text of some words.", "en", "s"),
    (2, "A plain text of some words.", None, None),
    (3, None, "en", "s"),
    (4, "", "en", "s"),
    (5, " \n\t ", None, "s"),
    (6, LONG, "en", "s"),
    (None, "A row without an id.", "en", None),
    (None, None, None, None),
    (7, "12345 !!! ...", "de", "s"),
]
PAGES = [
    (1, "https://a.example.org/es/1", "<article><p>One</p></article>"),
    (1, "https://a.example.org/es/1", "<article><p>One</p></article>"),
    (2, None, None),
    (3, "no url", ""),
    (None, "http://b.example.com/fr/", "<p>open <b>text"),
    (4, "http://b.example.com/fr/\r\nX", "<article><p>One</p></article>"),
]
VECTORS = [
    (1, [0.5] * 64, 0),
    (1, [0.5] * 64, 0),
    (2, [-0.01] * 64, 0),
    (3, None, 0),
    (4, [0.5] * 63, 0),
    (5, [0.5] * 63 + [None], 0),
    (6, [0.5] * 63 + [float("nan")], 0),
    (7, [0.5] * 63 + [float("inf")], 0),
    (8, [3e38] * 64, 0),
    (None, [0.25] * 64, None),
]
#: Columns that the operators use inside, and that a table may have as well.
CLASHES = ["fp", "row", "hits", "key", "found", "cut", "host", "digest", "words", "q", "t", "first"]
CLASHES += ["stats", "vector", "cluster", "distance", "n", "term", "terms", "rank", "score"]


def _write(spark, folder, empty):
    def save(name, rows, schema, clashes=()):
        frame = spark.createDataFrame([] if empty else rows, schema)
        frame.select("*", *(F.lit("x").alias(c) for c in clashes)).write.parquet(
            f"{folder}/{name}.parquet"
        )

    save("documents", DOCS, "doc_id long, text string, lang string, source string", CLASHES)
    save("pages", PAGES, "page_id long, url string, html string", CLASHES)
    items = [(1, "plain text of some"), (2, None), (None, "row without"), (3, "...")]
    save("benchmark", items, "item_id long, text string", CLASHES)
    labels = [(1, 1, 0), (6, 1, 0), (None, 1, 1), (7, None, None), (1, 1, 1)]
    save("labels", labels, "doc_id long, quality int, toxic int", CLASHES)
    save("embeddings", VECTORS, "vec_id long, embedding array<float>, label int", CLASHES)
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("odd"), empty=False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), empty=True)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, empty, name):
    assert llm.queries()[name](spark, empty).collect() == []


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def _by_id(frame, key="doc_id"):
    rows = frame.collect()
    assert len(rows) == (len(DOCS) if key == "doc_id" else len(PAGES))
    return {r[key]: r for r in rows}, rows


def test_language(spark, odd):
    found, _ = _by_id(llm.queries()["op1_language"](spark, odd))
    for key in (3, 4, 5, 7):
        assert (found[key].lang_pred, found[key].score) == ("und", 0.0)
    assert found[6].lang_pred == "en" and 0 < found[6].score <= 1


def test_urls(spark, odd):
    found, rows = _by_id(llm.queries()["op2_urls"](spark, odd), "page_id")
    assert (found[1].rule, found[1].verdict) == ("example.org/es/", "block")
    for key in (2, 3):
        assert tuple(found[key])[1:4] == ("", "", None)
    assert (found[None].rule, found[None].verdict) == ("com/fr/", "allow")
    assert found[4].path == "/fr/\r\nX"
    assert [r.page_id for r in rows].count(1) == 2


def test_licenses(spark, odd):
    found, _ = _by_id(llm.queries()["op3_licenses"](spark, odd))
    assert found[3][1:] == found[4][1:] == (0, 0, None, None, "", "", 0.0)
    assert found[6].n_words == 9 * 4000


def test_quality(spark, odd):
    found, _ = _by_id(llm.queries()["op4_quality"](spark, odd))
    for key in (3, 4, 5):
        assert found[key].n_words == 0 and found[key].base_failed and not found[key].kept
    assert found[6].n_repeat_words == 9 * 4000 and not found[6].kept


def test_bpe(spark, odd):
    found, _ = _by_id(llm.queries()["op5_bpe"](spark, odd))
    assert found[3][1:] == found[4][1:] == (0, EMPTY, EMPTY)
    assert found[6].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()


def test_toxicity(spark, odd):
    _, rows = _by_id(llm.queries()["op6_toxicity"](spark, odd))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_warc(spark, odd):
    found, rows = _by_id(llm.queries()["op7_warc"](spark, odd), "page_id")
    ones = [r for r in rows if r.page_id == 1]
    assert sorted(r.record_type for r in ones) == ["response", "revisit"]
    assert found[4].record_type == "revisit" and found[4].refers_to == 1
    assert (found[2].payload_bytes, found[2].record_type) == (0, "response")
    assert (found[3].record_type, found[3].refers_to) == ("revisit", 2)
    assert found[2].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_decontamination(spark, odd):
    found, rows = _by_id(llm.queries()["op8_decontaminate"](spark, odd))
    assert (found[2].n_hit, found[2].n_items, found[2].contaminated) == (4, 1, True)
    assert found[2].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert found[3][1:] == (0, 0, 0, EMPTY, False)
    # The item without an id is sought, but has no name.
    assert any((r.n_words, r.n_hit, r.n_items, r.contaminated) == (5, 2, 0, True) for r in rows)


def test_simhash(spark, odd):
    found, rows = _by_id(llm.queries()["op9_simhash"](spark, odd))
    assert found[2].component_id == 1
    zeros = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zeros} == {3} and len(zeros) == 4


def test_main_text(spark, odd):
    found, _ = _by_id(llm.queries()["op10_main_text"](spark, odd), "page_id")
    assert (found[1].text, found[1].n_chars) == ("One", 3)
    assert found[2].text == found[3].text == ""
    assert found[None].text == "open text"


def test_quality_model(spark, odd):
    _, rows = _by_id(llm.queries()["op11_quality_model"](spark, odd))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_search(spark, odd):
    found = llm.queries()["op12_search"](spark, odd).collect()
    first = sorted((r.rank, r.doc_id) for r in found if r.item_id == 1)
    # "plain text of some": three equal texts, by their ids.
    assert first == [(1, 1), (2, 1), (3, 2)]
    assert {r.item_id for r in found} == {1, None}
    assert (1, None) in {(r.rank, r.doc_id) for r in found if r.item_id is None}


def test_clusters(spark, odd):
    found = llm.queries()["op13_clusters"](spark, odd).collect()
    # Fewer vectors than clusters: each is a centroid, of equal ones the first has all.
    assert sorted(r.vec_id or 0 for r in found) == [0, 1, 1, 2, 8]
    assert {r.distance for r in found} == {r.inertia for r in found} == {0}
    assert len({r.cluster for r in found}) == 4


def test_pipeline_keeps_one_of_repeated_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, odd)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 6, 7]
    left = corpus_pipeline.drop_leaks(spark, kept, odd)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [3, 6, 7]
