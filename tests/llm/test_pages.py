import random
import time
from collections import defaultdict

import pytest

from parcelry.llm import pages as p
from parcelry.session import Staging


def _text(kind, html):
    return [text for k, text in p.blocks_of(html) if k == kind]


def test_article_only():
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header>"
        '<nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies</div><!-- <p>no</p> -->'
        '<div class="ad">Buy</div><form><label>Name</label><input></form>'
        "<article><h1>Title</h1><p>One &amp; <b>two</b>&#33;\n  three<br>four<p>five"
        '<aside>See also</aside><script>var t="</p>";</script><p>six</p></article>'
        '<section id="comments"><article><p>Nice!</p></article></section>'
        '<div class="sidebar">Links</div><footer>&copy; me</footer></body></html>'
    )
    assert " ".join(_text(p.MAIN, html)) == "Title One & two! three four five six"
    assert _text(p.OTHER, html) == []


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<article><p>cut off <b>he", "cut off he"),
        ("<form><article>in a form</article></form>", "in a form"),
        ("<ARTICLE CLASS='x>y'>q</ARTICLE>", "q"),
        ("<article><p title=it's>one</p><p>don't</p></article>", "one don't"),
        ('<article><p title="a>b" x="c>one</p></article>', "one"),
        ("<main><header><h1>Heading</h1></header>text<footer>tags</footer></main>", "Heading text"),
        ('<div role="main">by role</div>', "by role"),
        ("<article>a<script>if (a < b) x('</p>')</script>b</article>", "ab"),
        ("<article>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
        ('<article><p class="download-gradient">adapt</p></article>', "adapt"),
        ("<article>x<p hidden>no</p>y</article>", "x y"),
        ("", ""),
    ],
)
def test_pieces(html, expected):
    assert " ".join(_text(p.MAIN, html)) == expected


@pytest.mark.parametrize("seed", range(60))
def test_own_runs_against_brute_force(seed):
    rng, least = random.Random(seed), 4
    sites = [
        [" ".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(1, 5))
    ]
    seen = defaultdict(set)
    for number, blocks in enumerate(sites):
        for block in blocks:
            words = block.split()
            for i in range(len(words) - least + 1):
                seen[tuple(words[i : i + least])].add(number)
    expected = []
    for blocks in sites:
        own = []
        for block in blocks:
            words, common = block.split(), set()
            for i in range(len(words) - least + 1):
                if len(seen[tuple(words[i : i + least])]) > 1:
                    common.update(range(i, i + least))
            rest = [w for i, w in enumerate(words) if i not in common]
            if rest:
                own.append(" ".join(rest))
        expected.append(own)
    assert p.own_runs(sites, least) == expected


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array(seed):
    rng = random.Random(seed)
    import numpy as np

    tokens = rng.choices(range(2), k=rng.randint(1, 40)) + [-1]
    found = p.SuffixArray.of(np.array(tokens), 1 << 10)
    order = sorted(range(len(tokens)), key=lambda i: tokens[i:])
    assert found.order.tolist() == order
    for i in range(1, len(order)):
        a, b = tokens[order[i - 1] :], tokens[order[i] :]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert found.common[i] == same


def test_pages_without_article(spark):
    site = "<div>This very line is on all of the pages</div><p>{}</p><div>Call us now on 555 0100 please</div>"
    rows = [(i, f"http://h.example/{i}", site.format(f"Own words of page number {i} here")) for i in range(9)]
    rows.append((50, "http://other.example/", "<p>This very line is on all of the pages</p>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    with Staging(spark) as staging:
        for per_group in (1000, 5):
            found = {r.page_id: r.text for r in p.main_texts(frame, staging, per_group).collect()}
            assert len(found) == 10
            assert found[50] == "This very line is on all of the pages"
            # "Own words of page number" is shared too; the number and what follows are not.
            assert all(found[i] == f"{i} here" for i in range(9))


@pytest.mark.parametrize("per_group", [1000, 2, 1])
def test_runs_are_found_across_groups(spark, per_group):
    # Each line is on three pages of sixty only, which are hardly ever in one group.
    rng = random.Random(4)
    lines = [" ".join(f"site{i}x{k}" for k in range(30)) for i in range(20)]
    own = [" ".join(f"own{i}x{k}" for k in range(rng.randint(3, 40))) for i in range(60)]
    rows = [
        (i, f"http://h.example/{i}", f"<p>{own[i]}</p><div>{lines[i % 20]}</div>") for i in range(60)
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    with Staging(spark) as staging:
        found = {r.page_id: r.text for r in p.main_texts(frame, staging, per_group).collect()}
    assert found == dict(enumerate(own))


def test_copies_and_common_phrases_keep_their_text(spark):
    own = [" ".join(f"own{i}x{k}" for k in range(60)) for i in range(12)]
    phrase = "at the end of the day"
    # A phrase on a third of the pages; a line of 20 words on two; page 0 under three addresses.
    quote = " ".join(f"quote{k}" for k in range(20))
    texts = [f"{own[i]} {phrase if i % 3 == 0 else ''} {quote if i in (1, 2) else ''}" for i in range(12)]
    texts = [" ".join(t.split()) for t in [*texts, texts[0], texts[0]]]
    rows = [(i, f"http://h.example/{i}", f"<p>{t}</p><div>Call us now on 555 0100</div>") for i, t in enumerate(texts)]
    rows += [(100 + i, f"http://two.example/{i}", f"<p>{own[0]}</p>") for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    with Staging(spark) as staging:
        found = {r.page_id: r.text for r in p.main_texts(frame, staging).collect()}
    assert found == dict(enumerate(texts)) | {100: own[0], 101: own[0]}


def _main(page):
    return _text(p.MAIN, page)


def test_cards_in_sidebars_are_no_articles():
    page = (
        '<article>Main <aside class="related"><article>card</article></aside></article>'
        '<aside class="sidebar"><article><h3>Teaser</h3></article></aside><form><main>f</main></form>'
    )
    assert _main(page) == ["Main"]
    # Many sites wrap a whole page in a form.
    assert _main("<form><nav>n</nav><article>only</article></form>") == ["only"]


def test_names_of_a_whole_page_say_nothing_of_its_text():
    for page in (
        '<body class="no-sidebar"><div><p>own text</p></div></body>',
        '<html class="cookies"><body class="sidebar nav"><p>own text</p></body></html>',
        '<div class="page has-sidebar without-footer"><p>own text</p></div>',
    ):
        assert p.blocks_of(page) == [(p.OTHER, "own text")]
    assert p.blocks_of('<div class="sidebar">x</div>') == [(p.SKIPPED, "x")]


def test_deep_nesting_is_linear():
    began = time.process_time()
    assert p.blocks_of("<div>" * 100_000 + "</b>" * 100_000 + "x") == [(p.OTHER, "x")]
    assert p.blocks_of("<i><b>" * 50_000 + "</i></b>" * 50_000 + "y") == [(p.OTHER, "y")]
    assert time.process_time() - began < 10


def _main_texts(spark, rows, per_group):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    with Staging(spark) as staging:
        return {r.page_id: r.text for r in p.main_texts(frame, staging, per_group).collect()}


@pytest.mark.parametrize("per_group", [1000, 4, 1])
def test_articles_are_compared(spark, per_group):
    """What the site puts into its articles under a name that tells nothing goes."""
    site = "<div class='x1'>Read on for more of this with our app</div>"
    legal = " ".join(f"legal{k}" for k in range(30))
    own = [" ".join(f"own{i}x{k}" for k in range(60)) for i in range(12)]
    quote = "<p>a line that few of the pages quote</p>"
    article = "<article><h1>Page {}</h1><p>{}</p>{}{}<p>The end {} {}</p></article>"
    rows = [
        (i, f"http://h.example/{i}", article.format(i, own[i], site if i % 3 else "", quote if i < 5 else "", i, legal))
        for i in range(12)
    ]
    # Without a comparison to make: two pages, and a page without an article beside the others.
    rows += [(20 + i, f"http://two.example/{i}", article.format(i, own[i], site, "", i, legal)) for i in range(2)]
    rows += [(30, "http://h.example/list", "<p>" + own[11] + "</p>"), (31, None, None)]
    found = _main_texts(spark, rows, per_group)
    quoted = "a line that few of the pages quote "
    for i in range(12):
        assert found[i] == f"Page {i} {own[i]} {quoted if i < 5 else ''}The end {i}"
    for i in range(2):
        assert found[20 + i] == f"Page {i} {own[i]} Read on for more of this with our app The end {i} {legal}"
    assert (found[30], found[31], len(found)) == (own[11], "", 16)


def test_copied_articles_keep_their_text(spark):
    rng, words = random.Random(5), [f"w{k}" for k in range(200)]
    texts = []
    for i in range(9):  # six near copies, three of their own
        copy = list(words)
        copy[rng.randrange(200)] = f"edit{i}"
        texts.append(" ".join(copy if i < 6 else (f"own{i}x{k}" for k in range(80))))
    rows = [(i, f"http://h.example/{i}", f"<nav>{i}</nav><article><p>{texts[i % 9]}</p></article>") for i in range(18)]
    found = _main_texts(spark, rows, 1000)
    assert found == {i: texts[i % 9] for i in range(18)}


@pytest.mark.parametrize("seed", range(4))
def test_articles_against_brute_force(spark, seed, monkeypatch):
    """Groups of any size name the same runs as all articles of a host together."""
    rng, rows, expected = random.Random(seed), [], {}
    for host in range(3):
        lines = [" ".join(f"s{i}x{k}" for k in range(rng.choice([6, 12, 30]))) for i in range(6)]
        shares = [rng.choice([0.3, 0.45, 0.5, 0.55, 0.7]) for _ in lines]
        pages = []
        for i in range(rng.choice([2, 7, 20, 41])):
            own = [" ".join(f"own{i}x{j}x{k}" for k in range(50)) for j in range(4)]
            blocks = own + [line for line, share in zip(lines, shares) if rng.random() < share]
            rng.shuffle(blocks)
            pages.append(blocks)
        least = max(3, (len(pages) + 1) // 2)
        common = {line for line in lines if sum(line in blocks for blocks in pages) >= least}
        for i, blocks in enumerate(pages):
            rest = [b for b in blocks if b not in common]
            gone = sum(len(b.split()) for b in blocks if b in common)
            whole = 2 * gone > sum(len(b.split()) for b in blocks)
            expected[1000 * host + i] = " ".join(blocks if whole else rest)
            html = "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
            rows.append((1000 * host + i, f"http://h{host}.example/{i}", html))
            rows.append((1000 * host + i + 500, f"http://h{host}.example/copy/{i}", html))
    for per_group, size in ((1000, 1 << 30), (6, 1 << 30), (1000, 9000)):
        monkeypatch.setattr(p, "BYTES_A_GROUP", size)
        found = _main_texts(spark, rows, per_group)
        assert all(found[i] == text and found[i + 500] == text for i, text in expected.items())
        assert len(found) == 2 * len(expected)
