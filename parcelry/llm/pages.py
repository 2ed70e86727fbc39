"""Main text of web pages, with a suffix array of what the pages of a host share.

A page is cut into blocks of text: blocks of the article, menus, footers and the like, known by
their elements and names, and others. What of them is the page's own is settled by comparison:
the blocks of a host's pages make one stream of tokens, and a suffix array of it shows the runs
that the site repeats. Tags are evidence: from an article goes only what most of the host's
articles have, whole blocks or long runs. Pages without an article give their other blocks,
without long runs on several different pages and shorter ones on most.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.text import sliced, slices
from parcelry.llm.urls import host_of
from parcelry.session import StagedTable, Staging

MAIN, OTHER, SKIPPED = 0, 1, 2
_NESTED = 3  # an article in a part of the site, not settled yet

#: Pages of a host that one suffix array holds; what its groups find is counted together.
PAGES_A_GROUP = 1000
BYTES_A_GROUP = 16 << 20  # of html
MIN_RUN, LONG_RUN = 5, 25  # tokens
#: Runs that the site has put there: tokens, on how many different pages of the host at least,
#: and on which share of them. A phrase of a few words on some of the pages is their own.
RUNS = ((MIN_RUN, 3, 0.5), (LONG_RUN, 3, 0.0))
#: Of articles, on how many different ones of the host at least; it is half of them or more, too.
MIN_ARTICLES = 3
#: Contents that a task remembers, so as to pass on copies once.
_REMEMBERED = 100_000

#: Elements without content, elements that break a line of text, elements whose
#: content is no text, and elements that hold what belongs to the site rather than the page.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav
    ol option p pre section select summary table tbody td tfoot th thead title tr ul""".split()
)
NO_TEXT = frozenset(
    """audio button canvas datalist dialog embed head iframe input label math noscript object
    optgroup option script select style svg template textarea title video""".split()
)
SITE = frozenset("nav footer aside form menu".split())

#: Words of class, id and role that name parts of a page other than its article.
_NAMES = re.compile(
    r"""(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|
    cookies?|cookiebar|disqus|disclaimer|footer|gdpr|hidden|login|masthead|menu|modal|nav|navbar|
    navigation|navigational|newsletter|notice|notices|pagination|pager|popup|promo|promoted|
    promotion|related|replies|respond|search|share|sharing|shares|sidebar|sidebars|signup|
    skip|social|sponsor|sponsored|subscribe|subscription|toolbar|topbar|widget|widgets|
    complementary|contentinfo|site[_-]?header|page[_-]?header)(?=$|[\s_-])""",
    re.I | re.X,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?=$|[\s_-])", re.I)
_ARTICLES = re.compile(r"(?:^|\s)(?:article[_-]?(?:body|content|text)|post[_-]?(?:body|content)|entry[_-]?content|main[_-]?content)(?=$|\s)", re.I)
#: Names that say how a page is laid out, not what an element is.
_LAYOUT = re.compile(r"(?<!\S)(?:no|has|with|without)[_-]\S+", re.I)
_ATTRIBUTES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKENS = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))
    |<(script|style|textarea|title|iframe|noscript|noembed|xmp)\b(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+>.*?(?:</\1\b[^>]*>|\Z)
    |<(/?)([a-z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)(?:>|\Z)
    |<[!?/][^>]*(?:>|\Z)""",
    re.I | re.X | re.S,
)


def _kind(name: str, attributes: str, above: int, in_article: bool) -> tuple[int, bool]:
    """What the content of an element is, and whether nothing inside can be an article."""
    marks, role = "", ""
    if attributes and not attributes.isspace():
        for key, value in _ATTRIBUTES.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return SKIPPED, True
            role = value.lower() if key == "role" else role
            marks += f" {value}"
    # Names of the whole page tell about all of it, so nothing about a part.
    marks = "" if name in ("html", "body") else _LAYOUT.sub(" ", marks)
    if name in NO_TEXT or marks and _COMMENTS.search(marks):
        return SKIPPED, True
    if name in ("article", "main") or role in ("main", "article") or _ARTICLES.search(marks):
        return (_NESTED if above in (SKIPPED, _NESTED) else MAIN), False
    if name in SITE or name == "header" and not in_article or marks and _NAMES.search(marks):
        return SKIPPED, False
    return above, False


def blocks_of(page: str) -> list[tuple[int, str]]:
    """The blocks of a page, in order: what each is (article, other, part of the site) and its
    text with references decoded and white space made single.

    Elements left open end with what holds them. A comment section stays one even if a reader's
    comment is marked up as an article. An article in a sidebar, a form or the like, as the cards
    of related pages, is part of the site, unless the page has no other article. Work grows with
    the length of the page, however deep its elements are nested.
    """
    found: list[tuple[int, str]] = []
    pending: list[str] = []
    # Name, what its content is, whether for good, and whether it is in an article.
    stack: list[tuple[str, int, bool, bool]] = []
    opened: Counter[str] = Counter()
    kind, for_good, in_article = OTHER, False, False

    def flush() -> None:
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            if text:
                found.append((kind, text))
            pending.clear()

    at = 0
    for token in _TOKENS.finditer(page):
        if token.start() > at:
            pending.append(page[at : token.start()])
        at = token.end()
        name = token[3]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            flush()
        if token[2]:
            if opened[name]:
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
                if (stack[-1][1] if stack else OTHER) != kind:
                    flush()
        elif name not in VOID and not token[4].endswith("/"):
            own = (SKIPPED, True) if for_good else _kind(name, token[4], kind, in_article)
            if own[0] != kind:
                flush()
            stack.append((name, *own, in_article or own[0] in (MAIN, _NESTED)))
            opened[name] += 1
        kind, for_good, in_article = stack[-1][1:] if stack else (OTHER, False, False)
    pending.append(page[at:])
    flush()
    settled = SKIPPED if any(k == MAIN for k, _ in found) else MAIN
    return [(settled if k == _NESTED else k, text) for k, text in found]


@dataclass(frozen=True)
class SuffixArray:
    """Suffixes of a stream of tokens, sorted by their first tokens, and common prefixes.

    ``common[i]`` is how many tokens suffix ``order[i]`` shares with the one before it, as far as
    ``depth``, up to which suffixes are sorted.
    """

    order: np.ndarray
    common: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray, depth: int) -> "SuffixArray":
        n = len(tokens)
        _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        # A rank is one more than the number of suffixes before; those with equals are still tied.
        rank = (np.cumsum(counts) - counts + 1)[inverse]
        tied = np.flatnonzero(counts[inverse] > 1)
        levels, size = [rank], 1
        while size < depth and len(tied):
            behind = np.append(rank, np.zeros(1, np.int64))[np.minimum(tied + size, n)]
            key = rank[tied] * (n + 1) + behind
            by_key = np.argsort(key)
            key, tied = key[by_key], tied[by_key]
            at, old, new = np.arange(len(tied)), rank[tied], np.append(True, key[1:] != key[:-1])
            old_at = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
            rank = rank.copy()
            rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - old_at
            tied = tied[~(new & np.append(new[1:], True))]
            levels.append(rank)
            size *= 2
        order = np.argsort(rank, kind="stable")
        left, right = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n, np.int64)
        for level in range(len(levels) - 1, -1, -1):
            inside = (left < n) & (right < n)
            same = np.zeros(n - 1, bool)
            same[inside] = levels[level][left[inside]] == levels[level][right[inside]]
            # A rank stands for 2 ** level tokens or, near the end of the stream, for fewer; the
            # stream ends with a token of its own, so equal ranks stand for as many on both sides.
            step = np.where(same, 1 << level, 0)
            common[1:] += step
            left, right = left + step, right + step
        return cls(order, common)

    def counted(
        self, page: np.ndarray, least: int, some: int = 1
    ) -> tuple[np.ndarray, np.ndarray]:
        """A place of every different run of ``least`` tokens, and how many pages have it; without
        runs that stand at fewer than ``some`` places."""
        first = np.flatnonzero(self.common < least)
        places = np.diff(np.append(first, len(self.order)))
        many = places >= some
        run, kept = np.repeat(np.arange(many.sum()), places[many]), np.repeat(many, places)
        pages = int(page.max()) + 1
        found = np.unique(run * pages + page[self.order[kept]]) // pages
        return self.order[first[many]], np.bincount(found, minlength=many.sum())


class Stream:
    """The blocks of pages as one stream of tokens, with a border after each block."""

    def __init__(self, pages: list[list[str]]):
        self.pages = pages
        ids: defaultdict[str, int] = defaultdict()
        ids.default_factory = ids.__len__
        tokens, lengths, ends = [], [], -1
        for blocks in pages:
            before = len(tokens)
            for block in blocks:
                tokens += map(ids.__getitem__, block.split())
                tokens.append(ends)  # a border no other place has
                ends -= 1
            lengths.append(len(tokens) - before)
        self.tokens = np.array(tokens, np.int64)
        self.owner = np.repeat(np.arange(len(pages)), lengths)
        digests = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ids]
        self.digests = np.array([*digests, 0], np.uint64)  # a border has the last

    def keys(self, least: int) -> np.ndarray:
        """A hash of the run of ``least`` tokens at each place; it is the same in any stream."""
        n, found = len(self.tokens), np.zeros(len(self.tokens), np.uint64)
        digest = self.digests[np.maximum(self.tokens, -1)]
        for k in range(min(least, n)):
            found *= np.uint64(0x9E3779B97F4A7C15)
            found[: n - k] += digest[k:]
        return found.view(np.int64)

    def inside(self, least: int, places: np.ndarray | None = None) -> np.ndarray:
        """At which of all places a run of ``least`` tokens starts that no border cuts."""
        borders = np.flatnonzero(self.tokens < 0)
        at = np.arange(len(self.tokens)) if places is None else places
        return borders[np.searchsorted(borders, at)] - at >= least

    def runs(
        self, lengths: list[int], some: int = 1
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the hashes of all different runs on ``some`` pages at least, and how
        many pages have each."""
        if not len(self.tokens):
            return
        suffixes = SuffixArray.of(self.tokens, max(lengths))
        for least in lengths:
            places, n = suffixes.counted(self.owner, least, some)
            whole = (n >= some) & self.inside(least, places)
            keys = self.keys(least)[places[whole]] if whole.any() else np.zeros(0, np.int64)
            yield least, keys, n[whole]

    def covered(self, least: int, keys: np.ndarray) -> np.ndarray:
        """Which tokens are in a run of ``least`` tokens whose hash is given."""
        n = len(self.tokens)
        covered = np.zeros(n + least, np.int64)
        if len(keys) and n:
            first = np.flatnonzero(self.inside(least) & np.isin(self.keys(least), keys))
            np.add.at(covered, first, 1)
            np.add.at(covered, first + least, -1)
        return np.cumsum(covered)[:n] > 0

    def without(self, shared: dict[int, np.ndarray]) -> list[list[str]]:
        """The blocks of each page without the runs whose hashes, by length, are given."""
        common = np.zeros(len(self.tokens), bool)
        for least, keys in shared.items():
            common |= self.covered(least, keys)
        return self.rest(common)

    def rest(self, common: np.ndarray) -> list[list[str]]:
        """The blocks of each page without the tokens that are marked."""
        kept, at = [], 0
        for blocks in self.pages:
            own = []
            for block in blocks:
                words = block.split()
                rest = [w for w, gone in zip(words, common[at : at + len(words)]) if not gone]
                at += len(words) + 1
                if rest:
                    own.append(" ".join(rest))
            kept.append(own)
        return kept


def own_runs(pages: list[list[str]], least: int = MIN_RUN) -> list[list[str]]:
    """The blocks of each page without the runs of tokens that another page has too."""
    stream = Stream(pages)
    return stream.without({k: keys[n > 1] for k, keys, n in stream.runs([least])})


def _cut(column: pa.Array) -> pa.Array:
    rows = []
    for page in column.to_pylist():
        blocks = blocks_of(page or "")
        rows.append(
            {
                "wanted": all(kind != MAIN for kind, _ in blocks),
                "others": [text for kind, text in blocks if kind == OTHER],
            }
        )
    return pa.array(rows, pa.struct([("wanted", pa.bool_()), ("others", pa.list_(pa.string()))]))


def _count(key: tuple, group: pa.Table) -> pa.Table:
    """The runs of a group of contents; of a host that is one group, those on several only."""
    alone = group.column("groups")[0].as_py() == 1
    found = []
    for least, keys, n in Stream(group.column("others").to_pylist()).runs([r[0] for r in RUNS]):
        some = n > 1 if alone else n > 0
        columns = [np.full(some.sum(), least, np.int32), keys[some], n[some]]
        found.append(pa.table(columns, names=["tokens", "run", "n"]))
    table = pa.concat_tables(found) if found else _NO_RUNS
    host = pa.repeat(key[0], len(table)), pa.repeat(key[1], len(table))
    return table.add_column(0, "host", host[0]).add_column(1, "part", host[1])


def _without(contents: pa.Table, shared: pa.Table) -> pa.Table:
    tokens, run = (shared.column(c).to_numpy() for c in ("tokens", "run"))
    stream = Stream(contents.column("others").to_pylist())
    kept = stream.without({k: run[tokens == k] for k, *_ in RUNS})
    texts = pa.chunked_array([[" ".join(x) for x in kept]], pa.string())
    return contents.select(["host", "content"]).append_column("text", texts)


_NO_RUNS = pa.table(
    {"tokens": pa.array([], pa.int32()), "run": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}
)


def article_text(blocks: list[str], shared: dict[int, np.ndarray]) -> str:
    """An article without what the host's articles share: hashes of runs, by their length.

    A long run goes from within a block, shorter ones if they cover a block as a whole. If more
    than half of the article would go, it is a copy of others rather than one in their frame, and
    all of it stays.
    """
    stream = Stream([blocks])
    gone = stream.covered(LONG_RUN, shared[LONG_RUN])
    short, at = stream.covered(MIN_RUN, shared[MIN_RUN]), 0
    for block in blocks:
        words = slice(at, at + block.count(" ") + 1)
        gone[words] |= short[words].all()
        at = words.stop + 1
    own = [blocks] if 2 * gone.sum() > len(gone) - len(blocks) else stream.rest(gone)
    return " ".join(own[0])


def _article(page: str | None) -> list[str]:
    return [text for kind, text in blocks_of(page or "") if kind == MAIN]


def _by_length(runs: list[dict]) -> dict[int, np.ndarray]:
    return {
        k: np.array([r["run"] for r in runs if r["tokens"] == k], np.int64)
        for k in (MIN_RUN, LONG_RUN)
    }


def _digest(article: list[str]) -> bytes:
    text = "\n".join(article)  # no block has a line feed
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The articles of each host, copies mostly once a task; no blocks for a page without one."""
    seen: set[tuple[str, bytes]] = set()
    for rows in (part.to_pylist() for batch in batches for part in slices(batch)):
        found = []
        for row in rows:
            article = _article(row["html"])
            key = row["host"], _digest(article)
            if key not in seen:
                if len(seen) == _REMEMBERED:
                    seen.clear()
                seen.add(key)
                found.append((*key, "\n".join(article)))
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.string()))],
            names=["host", "content", "article"],
        )


def _count_articles(key: tuple, group: pa.Table) -> pa.Table:
    """How many articles a group has, and the runs on half of them or more."""
    contents = dict(zip(group.column("content").to_pylist(), group.column("article").to_pylist()))
    articles = [text.split("\n") for text in contents.values() if text]
    alone = group.column("groups")[0].as_py() == 1
    least = max((len(articles) + 1) // 2, MIN_ARTICLES if alone else 1)
    runs = []
    if len(articles) >= least:
        for tokens, keys, n in Stream(articles).runs([MIN_RUN, LONG_RUN], least):
            for run, pages in zip(keys.tolist(), n.tolist()):
                runs.append({"tokens": tokens, "run": run, "n": pages})
    some_open = len(articles) < len(contents)
    rows = [(key[0], len(articles), some_open, runs)] if runs or some_open or not alone else []
    names = ["host", "articles", "some_open", "runs"]
    return pa.Table.from_pylist([dict(zip(names, r)) for r in rows], _GROUPS)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the runs asked for each article has."""
    for rows in (part.to_pylist() for batch in batches for part in slices(batch)):
        found = []
        for row in rows:
            article = _article(row["html"])
            if not article:
                continue
            stream, content = Stream([article]), _digest(article)
            for tokens, asked in _by_length(row["runs"]).items():
                there = np.intersect1d(stream.keys(tokens)[stream.inside(tokens)], asked)
                found += [
                    {"host": row["host"], "content": content, "tokens": tokens, "run": run}
                    for run in there.tolist()
                ]
        yield pa.RecordBatch.from_pylist(found, _FOUND)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page that has an article."""
    for part in (part for batch in batches for part in slices(batch)):
        texts = []
        for row in part.select(["html", "runs"]).to_pylist():
            article = _article(row["html"])
            if row["runs"] and article:
                texts.append(article_text(article, _by_length(row["runs"])))
            else:
                texts.append(" ".join(article) if article else None)
        column = pa.array(texts, pa.string())
        whole = pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), column], names=["page_id", "url", "text"]
        )
        yield whole.filter(column.is_valid())


_GROUPS = pa.schema(
    [
        ("host", pa.string()),
        ("articles", pa.int64()),
        ("some_open", pa.bool_()),
        ("runs", pa.list_(pa.struct([("tokens", pa.int32()), ("run", pa.int64()), ("n", pa.int64())]))),
    ]
)
_FOUND = pa.schema(
    [("host", pa.string()), ("content", pa.binary()), ("tokens", pa.int32()), ("run", pa.int64())]
)


def _small(table: StagedTable) -> DataFrame:
    return F.broadcast(table.frame) if table.bytes < 8 << 20 else table.frame


def _runs_by_host(runs: DataFrame, staging: Staging) -> StagedTable:
    single = staging.write(runs)
    if not single.rows:
        return single
    each = F.collect_list(F.struct("tokens", "run")).alias("runs")
    found = staging.write(single.frame.groupBy("host").agg(each))
    return StagedTable(found.frame, found.rows, single.bytes)  # arrays count little there


def shared_by_articles(
    pages: DataFrame, staging: Staging, per_group: int
) -> tuple[StagedTable, StagedTable]:
    """Of ``host`` and ``html``: each host's runs that half of its different articles have, and
    the hosts that have pages without an article.

    A run on half of all articles is on half of those of some group, so the groups name all that
    come into question. Where a group does not name a run, less than half of its articles have it;
    runs that these bounds do not settle are counted once more.
    """
    groups = F.greatest(
        F.ceil(F.count(F.lit(1)) / per_group), F.ceil(F.sum(F.octet_length("html")) / BYTES_A_GROUP)
    )
    large = pages.groupBy("host").agg(groups.alias("groups")).where("groups > 1")
    named = staging.write(
        pages.mapInArrow(_articles, "host string, content binary, article string")
        .join(F.broadcast(large), "host", "left")
        .withColumn("groups", F.coalesce("groups", F.lit(1).cast("bigint")))
        .withColumn("part", F.pmod(F.xxhash64("content"), F.col("groups")))
        .groupBy("host", "part")
        .applyInArrow(
            _count_articles,
            "host string, articles long, some_open boolean,"
            " runs array<struct<tokens: int, run: long, n: long>>",
        )
    ).frame
    open_hosts = staging.write(named.where("some_open").select("host").distinct())
    unnamed = F.greatest(F.ceil(F.col("articles") / 2) - 1, F.lit(0))
    hosts = named.groupBy("host").agg(
        F.greatest(F.lit(MIN_ARTICLES), F.ceil(F.sum("articles") / 2)).alias("least"),
        F.sum(unnamed).alias("unnamed"),
    )
    bounds = staging.write(
        named.select("host", unnamed.alias("below"), F.inline("runs"))
        .groupBy("host", "tokens", "run")
        .agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
        .join(hosts, "host")
        .where("n + unnamed - below >= least")
        .select("host", "tokens", "run", "n", "least")
    ).frame
    shared = bounds.where("n >= least").select("host", "tokens", "run")
    unsettled = _runs_by_host(bounds.where("n < least").select("host", "tokens", "run"), staging)
    if unsettled.rows:
        found = pages.join(_small(unsettled), "host").select("host", "html", "runs")
        counted = (
            found.mapInArrow(_find, "host string, content binary, tokens int, run long")
            .distinct()
            .groupBy("host", "tokens", "run")
            .agg(F.count(F.lit(1)).alias("exact"))
            .join(bounds, ["host", "tokens", "run"])
            .where("n < least AND exact >= least")
        )
        shared = shared.unionByName(counted.select("host", "tokens", "run"))
    return _runs_by_host(shared, staging), open_hosts


def main_texts(pages: DataFrame, staging: Staging, per_group: int = PAGES_A_GROUP) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for every row of ``pages``.

    The articles of a host are compared with each other, and a page with an article gives its
    blocks without the runs of tokens that half of the host's articles share, three or more, as
    ``article_text`` says. For a page without an article, the blocks that are no
    known part of the site are compared with those of all the host's pages, and what is in none
    of the runs that ``RUNS`` describes stays. Pages with the same blocks count as one. NULL html
    is the empty page, whose text is empty. Pages without a host make a host of their own, so does
    NULL. A host of many pages is cut into groups of about ``per_group``, whose runs are counted
    together by their hashes, so the result does not depend on the groups.
    """
    pages = pages.select("page_id", "url", "html", host_of(F.coalesce("url", F.lit(""))).alias("host"))
    shared, open_hosts = shared_by_articles(pages.select("host", "html"), staging, per_group)
    if shared.rows:
        compared = pages.join(_small(shared), "host", "left")
    else:
        compared = pages.withColumn("runs", F.lit(None).cast("array<struct<tokens: int, run: long>>"))
    page_id = pages.schema["page_id"].dataType.simpleString()
    whole = compared.select("page_id", "url", "html", "runs").mapInArrow(
        _texts, f"page_id {page_id}, url string, text string"
    )
    if not open_hosts.rows:
        return _with_length(whole)
    cut = staging.write(
        pages.join(_small(open_hosts), "host", "left_semi")
        .select("page_id", "url", "host", F.arrow_udf(_CUT)(sliced(_cut))("html").alias("cut"))
        .select("page_id", "url", "host", "cut.wanted", "cut.others")
    ).frame
    open_pages = cut.where("size(others) > 0 OR wanted").select(
        "page_id", "url", "others", "wanted", "host",
        F.sha2(F.array_join("others", "\n"), 256).alias("content"),  # no block has a line feed
    )
    sizes = (
        open_pages.groupBy("host", "content")
        .agg(F.bool_or("wanted").alias("wanted"))
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_contents"), F.bool_or("wanted").alias("some_wanted"))
    )
    hosts = staging.write(
        sizes.where("some_wanted").select(
            "host", "n_contents", F.ceil(F.col("n_contents") / per_group).cast("int").alias("groups")
        )
    )
    few = _small(hosts)
    contents = staging.write(
        open_pages.select("host", "content", "others")
        .join(few, "host")
        .dropDuplicates(["host", "content"])
        .withColumn("part", F.pmod(F.xxhash64("content"), F.col("groups")))
    ).frame
    runs = staging.write(
        contents.groupBy("host", "part").applyInArrow(
            _count, "host string, part long, tokens int, run long, n long"
        )
    ).frame
    least = F.lit(None)
    for tokens, some, share in RUNS:
        enough = F.greatest(F.lit(some), F.ceil(F.col("n_contents") * share))
        least = F.when(F.col("tokens") == tokens, enough).otherwise(least)
    shared = (
        runs.groupBy("host", "tokens", "run")
        .agg(F.sum("n").alias("n"))
        .join(few, "host")
        .where(F.col("n") >= least)
        .select("host", "tokens", "run")
    )
    seen = runs.join(shared, ["host", "tokens", "run"]).select("host", "part", "tokens", "run")
    compared = (
        contents.groupBy("host", "part")
        .cogroup(seen.groupBy("host", "part"))
        .applyInArrow(_without, "host string, content string, text string")
    )
    wanted = open_pages.where("wanted").join(compared, ["host", "content"])
    return _with_length(whole.unionByName(wanted.select("page_id", "url", "text")))


def _with_length(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_CUT = "wanted boolean, others array<string>"
