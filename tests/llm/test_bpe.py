import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from parcelry.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary, held=500)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


TEXTS = st.text(
    st.one_of(st.sampled_from("etaoin  \n\t'sS19éüßñ!"), st.characters(exclude_categories=["Cs"])),
    max_size=60,
)
PIECES = st.binary(max_size=40) | st.text("abcdehint", max_size=40).map(str.encode)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_same_ids_as_the_library(encoder, library, text):
    ids = memoryview(encoder.encode(text)).cast("I").tolist()
    assert ids == library.encode_ordinary(text)
    assert encoder.decode(encoder.encode(text)) == text.encode()


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_same_ids_as_merging_pairs(encoder, vocabulary, text):
    ids = memoryview(encoder.encode(text)).cast("I").tolist()
    assert ids == bpe.reference_ids(text, vocabulary)


@settings(max_examples=200, deadline=None)
@given(PIECES, PIECES)
def test_append_is_exact(encoder, start, more):
    last = encoder.extend(start, [])
    before = list(last)
    appended = encoder.extend(start + more, last)
    assert appended == encoder.extend(start + more, [])
    assert appended[: len(start)] == before


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(0, 40), st.integers(0, 40), PIECES)
def test_edit_is_exact(encoder, piece, a, b, new):
    start, end = sorted((min(a, len(piece)), min(b, len(piece))))
    changed, last = encoder.edit(piece, encoder.extend(piece, []), start, end, new)
    assert changed == piece[:start] + new + piece[end:]
    assert last == encoder.extend(changed, [])


def test_long_runs(encoder, library):
    for text in ("a" * 5000, " " * 5000, "ab" * 3000, "é" * 2000):
        assert memoryview(encoder.encode(text)).cast("I").tolist() == library.encode_ordinary(text)
