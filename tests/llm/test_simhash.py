import random

import pytest
from pyspark.sql import functions as F

from parcelry.llm import simhash
from parcelry.llm.components import _large_star, _small_star, components
from parcelry.session import Staging


@pytest.fixture
def staging(spark):
    with Staging(spark) as found:
        yield found


def _brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {n: root(n) for n in nodes}


def _brute_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(
    "text", ["", " \t", "One", "one Two", "a b c", "a a a a a a", "É x\x0by z w", "x " * 500]
)
def test_fingerprint(text):
    assert simhash.fingerprint_of(simhash.spaced_words(text)) == _brute_fingerprint(text)


def _near(rng, base, n):
    found = set()
    while len(found) < n:
        fp = base
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            fp ^= 1 << bit
        found.add(fp)
    return found


@pytest.mark.parametrize("cell", [3, 2048])
def test_links_reach_all_and_no_more(spark, staging, cell):
    rng = random.Random(cell)
    fps = _near(rng, rng.getrandbits(64), 60) | {rng.getrandbits(64) for _ in range(60)} | {0}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs = simhash.links(frame, staging, cell=cell).collect()
    mask = (1 << 64) - 1
    assert all((p.a ^ p.b) & mask and ((p.a ^ p.b) & mask).bit_count() <= 3 for p in pairs)
    expected = _brute_components(signed, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    links = {(p.a, p.b) for p in pairs} | {(p.b, p.a) for p in pairs}
    assert _brute_components(signed, lambda a, b: (a, b) in links) == expected


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, staging, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += [(i, i + 1) for i in range(100, 130)]  # a chain
    found = components(spark.createDataFrame(edges, "a long, b long"), staging).collect()
    links = {frozenset(e) for e in edges}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    expected = _brute_components(nodes, lambda a, b: frozenset((a, b)) in links)
    assert {r.node: r.root for r in found} == {n: r for n, r in expected.items() if n != r}


def test_no_links(spark, staging):
    assert components(spark.createDataFrame([], "a long, b long"), staging).collect() == []


def test_one_of_each_without_ids(spark, staging):
    rows = [(None, "same text here"), (None, "same text here"), (None, "another one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    assert sorted(r.text for r in simhash.one_of_each(docs, staging).collect()) == [
        "another one",
        "same text here",
    ]


@pytest.fixture
def skewed(spark):
    """No broadcasts, and limits so low that a third of a small table counts as skewed."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


@pytest.mark.parametrize("star, middle", [(_large_star, 0), (_small_star, 1 << 40)])
def test_a_star_of_a_third_of_all_links_is_cut(spark, skewed, staging, star, middle):
    """Of 60,000 links 20,000 meet in one node, smaller or larger than all others."""
    i = F.col("id")
    edges = staging.write(
        spark.range(60000)
        .repartition(8)
        .select(
            F.when(i < 20000, F.lit(middle)).otherwise(i * 2 + 1).cast("long").alias("a"),
            F.when(i < 20000, i + 200001).otherwise(i * 2 + 2).cast("long").alias("b"),
        )
    ).frame
    joined = star(edges)
    assert len(joined.collect()) == 60000
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_large_star_without_broadcasts(spark, skewed, staging):
    edges = spark.range(30000).select(F.lit(7).cast("long").alias("a"), (F.col("id") + 8).alias("b"))
    edges = edges.union(spark.createDataFrame([(8, 3), (40000, 40001)], "a long, b long"))
    found = components(edges, staging)
    assert found.groupBy("root").count().orderBy("root").collect() == [(3, 30001), (40000, 1)]
