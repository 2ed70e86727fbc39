import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelry.llm import queries, urls, warc
from parcelry.session import Staging

RULES = [("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x/y", "allow"), ("b.com", "", "block")]


def _judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (len(h + p), h + p, v)
        for h, p, v in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, "deny" if host == "spam.net" else "allow")))


def test_urls_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.org", "A.Org", "w.a.org", "xa.org", "org", "b.com", "c.b.com", "com", "", "spam.net", "a.org:80", "É.org"]
    tails = ["", "/", "/x", "/x/y?q=/z", "/xy#/", "?a=://b", "/X", "#f", "/x/y/z"]
    rows = [(i, f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(tails)}") for i in range(150)]
    rows += [(200, None), (201, ""), (202, "a.org/x"), (None, "http://a.org/x"), (1, rows[1][1]), (1, "http://b.com")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1))
    rules = spark.createDataFrame(RULES + [(None, "/", "block")], "host string, path string, verdict string")
    blocked = spark.createDataFrame([("spam.net", "/nope"), ("spam.net", "")], "host string, path string")
    for max_blocks in (urls.MAX_BLOCKS, 1):
        found = urls.judge_urls(pages, rules, blocked, max_blocks=max_blocks).collect()
        expected = Counter(
            (i, *("block" if x == "deny" else x for x in _judge(url))) for i, url in rows
        )
        assert Counter(tuple(r) for r in found) == expected


def test_filter_misses_nothing_and_little_passes(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = urls.build_filter(keys)
    import numpy as np

    def held(prefix):
        return bloom.may_hold(np.array([urls.key_hash(f"{prefix}{i}") for i in range(3000)], np.uint64))

    assert held("k").all()
    assert held("other").mean() < 0.05


def test_a_large_list_given_to_the_query(spark, tmp_path):
    n = 40_000
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}{i}.net/x") for i in range(n)]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("html", F.lit(""))
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    listed = [(f"bad{i}.net", "/") for i in range(1, 3 * n, 2)]
    blocked = spark.createDataFrame(listed, "host string, path string")
    # Some hosts that are not listed pass the filter; the join has to find them out.
    keys = urls.listed_keys(spark.createDataFrame([], "host string, path string, verdict string"), blocked)
    hashes = np.array([urls.key_hash(f"good{i}.net/") for i in range(0, n, 2)], np.uint64)
    assert urls.build_filter(keys).may_hold(hashes).any()
    found = queries.op2_urls(spark, str(tmp_path), blocked).collect()
    assert len(found) == n
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in found)


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urls.judge_urls(pages, rules).collect()] == [(1, "a.org", "/", None, "allow")]


BODIES = ["", "<p>x</p>", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é" * 3000, "a\r\n", "\n"]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    rows = [(i, f"http://h/{i % 3}\r\n", BODIES[i % len(BODIES)]) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    path = str(tmp_path / "archive")
    with Staging(spark) as staging:
        records = warc.resolve_revisits(pages, staging)
        warc.write_archives(
            records, path, "2024-01-01T00:00:00Z", per_file=3, compression=compression
        )
    found = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(found) == 30
    for i, url, html in rows:
        data, r = html.encode(), found[i]
        first = i % len(BODIES)
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.target_uri == f"http://h/{i % 3}%0D%0A"
        if i == first:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first, None)


def test_small_payloads_may_stay_responses(spark):
    rows = [(2, None, "ab"), (1, None, "ab"), (3, None, "abc"), (4, None, "abc")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    with Staging(spark) as staging:
        records = warc.resolve_revisits(pages, staging, min_bytes=3)
        found = records.select("page_id", "refers_to").collect()
    assert {r.page_id: r.refers_to for r in found} == {1: None, 2: None, 3: None, 4: 3}


def test_a_damaged_record_is_an_error():
    with pytest.raises(ValueError):
        list(warc._parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))
