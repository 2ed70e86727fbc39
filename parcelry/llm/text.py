"""Words as several operators take them, and texts a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows of a batch that are Python objects at the same time; a batch may be tens of megabytes.
ROWS = 256

#: Lower case for A-Z; every other ASCII character but a-z and 0-9 separates words.
_WORD_BYTES = bytes(
    c | 0x20 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 0x80 else 0x20
    for c in range(256)
)
_LOWER = bytes(c | 0x20 if 65 <= c <= 90 else c for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and all characters beyond ASCII, A-Z lower-cased; NULL has none."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """What stands between the white space of ASCII, A-Z lower-cased; NULL has none."""
    return text.encode().translate(_LOWER).split() if text else []


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch, or a column, in parts of a few rows."""
    return (batch.slice(at, ROWS) for at in range(0, len(batch), ROWS))


def sliced(
    function: Callable[[pa.Array], pa.Array],
) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """A function of a column as one for an Arrow UDF that sees a few rows at a time."""

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from map(function, slices(batch))

    return apply
