"""What a merge adds: pure functions from (source rows, target rows) to new rows.

Copies are collapsed by ``distinct`` or an aggregate before every join. Spark
runs both of them once per input task before it shuffles, so a row that was
delivered a million times, or a target that holds stale copies, reaches the
shuffle once per task and a join key meets at most one row on the right side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NULLS = "__nulls"
_HASH = "__hash"
DIGEST = "__digest"
#: Columns that mostly hold hexadecimal digits. Shuffle files hardly compress these.
HASHES = ("top_hash", "multihash")
TAG_KEY = ("registry", "pkg_name", "tag_name")
_REVISION_KEY = ("registry", "pkg_name", "top_hash")


def _nullable(key: Sequence[str]) -> list[str]:
    """Key columns that may be NULL: all but the registry, which the merge sets itself."""
    return [name for name in key if name != "registry"]


def encode_key(frame: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replaces NULLs in the (string) key columns, noting in a bit mask where they were.

    Plain equality of the result is null-safe equality of the key. An aggregate
    and a join on it share one shuffle; with ``<=>`` on the raw columns each
    would need its own. ``decode_key`` gives the raw columns back.
    """
    mask = F.lit(0)
    for position, name in enumerate(_nullable(key)):
        mask = mask + F.when(F.col(name).isNull(), 1 << position).otherwise(0)
    filled = {name: F.coalesce(name, F.lit("")) for name in _nullable(key)}
    return frame.withColumns({_NULLS: mask}).withColumns(filled)


def decode_key(frame: DataFrame, key: Sequence[str]) -> DataFrame:
    raw = {
        name: F.when(F.col(_NULLS).bitwiseAND(1 << position) == 0, F.col(name))
        for position, name in enumerate(_nullable(key))
    }
    return frame.withColumns(raw).drop(_NULLS)


def _encoded(key: Sequence[str]) -> list[str]:
    return [*key, _NULLS]


def hash_join(left: DataFrame, right: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Join on the key with its hash in front.

    Spark cuts a skewed left side into several tasks, but only if both sides
    are shuffled for this join. A right side that was aggregated by the key is
    taken as it is; the hash makes Spark shuffle it, and sorts faster than text.
    """
    hashed = F.xxhash64(*key)
    return (
        left.withColumn(_HASH, hashed)
        .join(right.withColumn(_HASH, hashed), [_HASH, *key], how)
        .drop(_HASH)
    )


def pack_hashes(frame: DataFrame) -> DataFrame:
    """The hashes as bytes, half as long, for a shuffle; ``unpack_hashes`` gives the texts back.

    A first byte says whether a text was one of hexadecimal digits in small letters, of even
    number. Any other text is kept byte for byte and NULL stays NULL, so different texts give
    different bytes.
    """

    def packed(text: Column) -> Column:
        plain = F.concat(F.lit(b"t"), text.cast("binary"))
        digits = F.unhex(text)
        return F.when(
            F.lower(F.hex(digits)) == text, F.concat(F.lit(b"x"), digits)
        ).otherwise(plain)

    kinds = dict(frame.dtypes)
    return frame.withColumns({c: packed(F.col(c)) for c in HASHES if kinds.get(c) == "string"})


def unpack_hashes(packed: DataFrame) -> DataFrame:
    def text(column: Column) -> Column:
        rest = F.substring(column, 2, 2**31 - 1)
        return F.when(F.substring(column, 1, 1) == F.lit(b"x"), F.lower(F.hex(rest))).otherwise(
            rest.cast("string")
        )

    kinds = dict(packed.dtypes)
    return packed.withColumns({c: text(F.col(c)) for c in HASHES if kinds.get(c) == "binary"})


def distinct_rows(frame: DataFrame) -> DataFrame:
    """Each row once."""
    return unpack_hashes(pack_hashes(frame).distinct())


def distinct_keys(frame: DataFrame, key: Sequence[str]) -> DataFrame:
    return encode_key(frame.select(*key), key).distinct()


def key_digest(key: Sequence[str]) -> Column:
    """SHA-256 of the key: 32 bytes, however long its texts are.

    Each text goes in with its length in front, and a NULL without one, so different keys give
    different bytes, and so different digests.
    """
    parts = [
        F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), F.col(name)), F.lit("-"))
        for name in key
    ]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def key_has_null(key: Sequence[str]) -> Column:
    """Whether some part of the key is NULL."""
    return F.greatest(*(F.col(name).isNull() for name in key))


def _known_digests(target: DataFrame, key: Sequence[str], null_safe: bool) -> DataFrame:
    # Under plain equality a key with a NULL part equals no other key.
    known = target if null_safe else target.dropna(subset=list(key))
    return known.select(key_digest(key).alias(DIGEST)).distinct()


def new_rows(
    source: DataFrame, target: DataFrame, key: Sequence[str], null_safe: bool = True
) -> DataFrame:
    """Distinct source rows whose key the target does not have.

    Rows that share a key but differ elsewhere are all new together, or none of
    them is. With ``null_safe=False`` a key with a NULL part is always new.
    """
    known = _known_digests(target, key, null_safe)
    digested = pack_hashes(source.withColumn(DIGEST, key_digest(key)))
    new = hash_join(digested, known, [DIGEST], "left_anti").drop(DIGEST).distinct()
    return unpack_hashes(new)


def new_keys(
    source: DataFrame, target: DataFrame, key: Sequence[str], null_safe: bool = True
) -> DataFrame:
    """Digests of the keys of ``new_rows``; nothing but digests is moved.

    No digest occurs twice on either side, so nothing can be skewed and each
    side is shuffled once.
    """
    known = _known_digests(target, key, null_safe)
    return source.select(key_digest(key).alias(DIGEST)).distinct().join(known, DIGEST, "left_anti")


def rows_with_key(
    source: DataFrame, keys: DataFrame, key: Sequence[str], pack: bool = False
) -> DataFrame:
    """Source rows whose key is among ``keys`` (as made by ``new_keys``). With ``pack`` their hashes
    are shuffled as bytes, which is of no use if the keys are broadcast."""
    digested = source.withColumn(DIGEST, key_digest(key))
    if pack:
        digested = pack_hashes(digested)
    found = hash_join(digested, keys, [DIGEST], "left_semi").select(*source.columns)
    return unpack_hashes(found) if pack else found


def rows_without_key(source: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Source rows whose key is not among ``keys``."""
    digested = source.withColumn(DIGEST, key_digest(key))
    return hash_join(digested, keys, [DIGEST], "left_anti").select(*source.columns)


def tags_to_append(tags: DataFrame, target: DataFrame) -> DataFrame:
    """Append-only tag merge: tags that are new, or differ from a row of the target.

    Old rows stay in the target, so once a tag has moved it keeps differing
    from one of them. The target is reduced to one row per key first: a tag
    differs from some row exactly if it differs from the least or the greatest.
    """
    held = target.groupBy(*TAG_KEY).agg(
        F.min("top_hash").alias("__least"),
        F.max("top_hash").alias("__greatest"),
        F.bool_or(F.col("top_hash").isNull()).alias("__unset"),
    )
    differs = (F.col("top_hash") != F.col("__least")) | (F.col("top_hash") != F.col("__greatest"))
    return (
        hash_join(tags.distinct(), held, TAG_KEY, "left")
        .where(F.col("__unset").isNull() | F.col("__unset") | differs)
        .select(*tags.columns)
    )


def choose_tags(tags: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row per registry, package and tag.

    Of several hashes the one with the newest revision wins, then the greatest. Most tags have
    one hash and need no date: only the others are joined with the revisions, and only the
    revisions that these name are grouped.
    """
    by_key = tags.groupBy(*TAG_KEY).agg(
        F.min("top_hash").alias("__least"),
        F.max("top_hash").alias("top_hash"),
        F.bool_or(F.col("top_hash").isNull()).alias("__unset"),
    )
    single = ~F.col("__unset") & (F.col("__least") == F.col("top_hash"))
    unset = F.col("__unset") & F.col("top_hash").isNull()
    several = by_key.where(~(single | unset))
    rivals = hash_join(
        encode_key(tags, TAG_KEY).distinct(), distinct_keys(several, TAG_KEY), _encoded(TAG_KEY), "left_semi"
    )
    rivals = encode_key(decode_key(rivals, TAG_KEY).select(*tags.columns), _REVISION_KEY)
    named = rivals.select(*_encoded(_REVISION_KEY)).distinct()
    created = (
        hash_join(
            encode_key(revisions.select(*_REVISION_KEY, "timestamp"), _REVISION_KEY),
            named,
            _encoded(_REVISION_KEY),
            "left_semi",
        )
        .groupBy(*_encoded(_REVISION_KEY))
        .agg(F.max("timestamp").alias("__created"))
    )
    dated = (
        decode_key(rivals.join(created, _encoded(_REVISION_KEY), "left"), _REVISION_KEY)
        .groupBy(*TAG_KEY)
        .agg(F.max_by("top_hash", F.struct("__created", "top_hash")).alias("top_hash"))
    )
    return by_key.where(single | unset).select(*TAG_KEY, "top_hash").unionByName(dated)


def changed_tags(chosen: DataFrame, target: DataFrame) -> DataFrame:
    """Chosen tags the target does not hold as its single row for the key."""
    held = (
        encode_key(target.select(*TAG_KEY, F.col("top_hash").alias("__held")), TAG_KEY)
        .groupBy(*_encoded(TAG_KEY))
        .agg(F.count(F.lit(1)).alias("__copies"), F.max("__held").alias("__held"))
    )
    settled = (F.col("__copies") == 1) & F.col("top_hash").eqNullSafe(F.col("__held"))
    changed = (
        encode_key(chosen, TAG_KEY)
        .join(held, _encoded(TAG_KEY), "left")
        .where(F.col("__copies").isNull() | ~settled)
    )
    return decode_key(changed, TAG_KEY).select(*chosen.columns)


def replace_tags(target: DataFrame, tags: DataFrame) -> DataFrame:
    """The target with its rows for the keys of ``tags`` replaced by ``tags``."""
    replaced = distinct_keys(tags, TAG_KEY)
    kept = hash_join(encode_key(target, TAG_KEY), replaced, _encoded(TAG_KEY), "left_anti")
    return decode_key(kept, TAG_KEY).select(*tags.columns).unionByName(tags)


def upsert_tags(tags: DataFrame, target: DataFrame, revisions: DataFrame) -> DataFrame:
    """Full tag state after the merge: one row per key of the source, others untouched."""
    return replace_tags(target, choose_tags(tags, revisions))
