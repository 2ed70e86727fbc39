"""The pipeline against a plain version over the smallest tables."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from parcelry.llm import bpe, quality, toxicity
from parcelry.session import Staging
from tests.llm.test_decontaminate import _brute as brute_leaks
from tests.llm.test_simhash import _brute_components, _brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    tables = {
        name: spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels", "benchmark")
    }
    docs = {r.doc_id: r.text for r in tables["documents"].collect()}
    references = quality.fit_references(tables["documents"])
    docs = {i: t for i, t in docs.items() if quality.judge(t, references, quality.Limits())[6]}
    left = tables["documents"].where(F.col("doc_id").isin(*docs))
    with Staging(spark) as staging:
        lexicon = toxicity.learn_lexicon(left, tables["labels"], staging)
    automaton = lexicon.automaton()

    def toxic(text):
        words = toxicity.fold(text)
        return toxicity._score(toxicity._evidence(words, automaton)[0], len(words)) >= 0.7

    docs = {i: t for i, t in docs.items() if not toxic(t)}
    prints = {i: _brute_fingerprint(t) for i, t in docs.items()}
    groups = _brute_components(docs, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    docs = {i: t for i, t in docs.items() if groups[i] == i}
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    hit = brute_leaks(list(docs.items()), items)
    docs = {i: t for i, t in docs.items() if not hit[i][1]}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    expected = {}
    for i, text in docs.items():
        ids = np.array(library.encode_ordinary(text), "<u4")
        expected[i] = (
            len(ids),
            hashlib.sha256(ids.tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == expected and len(found) == len(expected)
    assert 0 < len(expected) < 200
