import random
import re
import time

import pytest

from parcelry.llm import licenses

TEXTS = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "All rights reserved.": "reserved",
    "CC BY": "cc-by",
    "Mozilla Public License 2.0 and the Apache License 2.0": "apache-2.0,mpl-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "Copyright (c) 2020": "copyright",
    "mit der Lizenz": "",
    "a GNU general public licence": "",
}


def _scan(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}


def test_labels(spark):
    found = _scan(spark, [f"Some text. {t} More text." for t in TEXTS])
    assert [found[i].labels for i in range(len(TEXTS))] == list(TEXTS.values())


def test_there_are_hundreds_of_rules_and_their_keywords_hold():
    rules = licenses.rules()
    assert len(rules) >= 300
    for rule in rules:
        re.compile(rule.pattern)
        assert any(w in rule.keywords[0] or rule.keywords[0].startswith(w) for w in licenses.GATES) or (
            # Too common for a gate; their rules pass by "license" and "commercial".
            rule.keywords[0] in ("mit licen", "non")
        )


def test_contained_detections_are_suppressed(spark):
    # The grant holds the name; within "cc by nc 4 0" lies "cc by nc".
    found = _scan(spark, ["x licensed under the cc by nc 4 0 y", "x cc by nc y", "see license file"])
    assert (found[0].labels, found[0].score) == ("cc-by,cc-by-nc-4.0", 1.0)
    assert (found[1].labels, found[1].score) == ("cc-by,cc-by-nc", 0.8)
    assert (found[2].labels, found[2].score) == ("license-mention", 0.4)


@pytest.mark.parametrize("seed", range(3))
def test_base_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["CC", "by", "general", "Public", "license", "all", "rights", "RESERVED", "É", "x1", "K", "İ"]
    marks = [" ", "-", ".\n", "_", "  ", "\x00", "\x7f"]
    texts = [
        "".join(rng.choice(pool) + rng.choice(marks) for _ in range(rng.randint(0, 40)))
        for _ in range(60)
    ] + [None, "", "...", "cc by cc by", "-cc by-", "cc by " * 3000]
    found = _scan(spark, texts)
    for i, text in enumerate(texts):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        starts, labels = [], set()
        for label, phrase in licenses.BASE_PHRASES.items():
            for at in range(len(words) - len(phrase) + 1):
                if tuple(words[at : at + len(phrase)]) == phrase:
                    starts.append(at)
                    labels.add(label)
        r = found[i]
        assert (r.n_words, r.n_base) == (len(words), len(starts))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def _fitting(pattern, most):
    """A text that a rule's pattern fits, with all optional parts or with none."""

    def text(parts):
        found = ""
        for kind, value in parts:
            kind = str(kind)
            if kind == "LITERAL":
                found += chr(value)
            elif kind == "IN":
                found += {"LITERAL": lambda v: chr(v), "CATEGORY": lambda v: "0"}[str(value[0][0])](value[0][1])
            elif kind == "MAX_REPEAT":
                found += text(value[2]) * (value[1] if most else value[0])
            elif kind == "SUBPATTERN":
                found += text(value[3])
            elif kind == "BRANCH":
                found += text(value[1][-1 if most else 0])
            else:
                assert kind in ("ASSERT", "ASSERT_NOT"), kind
        return found

    return text(re._parser.parse(pattern))


@pytest.mark.parametrize("most", [False, True])
def test_every_rule_labels_a_text(spark, most):
    rules = licenses.rules()
    texts = [_fitting(r.pattern, most) for r in rules]
    found = _scan(spark, [f"Some {t} text" for t in texts])
    missed = [(r.label, t, found[i].labels) for i, (r, t) in enumerate(zip(rules, texts))
              if r.label not in found[i].labels.split(",")]
    assert missed == []


def test_short_forms_and_spdx_lines(spark):
    texts = {
        "Released under GPL2.": "gpl-2.0",
        "Use LGPL3": "lgpl-3.0",
        "under the GPLv3": "gpl-3.0",
        "SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
        "SPDX-License-Identifier: AGPL-3.0-or-later": "agpl-3.0",
        "SPDX-License-Identifier: BSL-1.0": "boost-1.0",
        "SPDX-License-Identifier: MIT-0": "",
        "Distributed under MPL-2.0": "mpl-2.0",
    }
    found = _scan(spark, list(texts))
    assert [found[i].labels for i in range(len(texts))] == list(texts.values())


def test_a_license_has_one_label_however_it_is_written(spark):
    texts = {
        "the Expat License": "mit",
        "Creative Commons Attribution 4.0 International": "cc-by-4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International": "cc-by-nc-4.0",
        "https://creativecommons.org/licenses/by-nc/4.0/": "cc-by-nc-4.0",
        "CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "GNU Lesser General Public License, version 3": "gpl,lgpl-3.0",
    }
    found = _scan(spark, list(texts))
    assert [found[i].labels for i in range(len(texts))] == list(texts.values())


def test_patterns_written_by_hand():
    by_hand = [
        *(name for _, name in licenses.NAMES.values()), *(name for _, _, name in licenses.SHORT),
        *licenses.SPDX.values(), *licenses.GRANTS.values(),
        *(pattern for *_, pattern in licenses.OTHERS), *(pattern for *_, pattern in licenses.NOTICES),
    ]
    assert len(set(by_hand)) >= 200


def _plainly(text):
    """Labels and score by comparing every detection with every other."""
    words = [w for w in re.split(licenses.SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    joined = f" {' '.join(words)} "
    spans = {
        (m.start(), m.end(), r.rank, r.label)
        for r in licenses.rules()
        if all(k in joined for k in r.keywords)
        for m in re.finditer(r.pattern, joined)
    }

    def hidden(s, o):
        inside = o[0] <= s[0] and s[1] <= o[1] and o[2] <= s[2]
        return inside and (o[:2] != s[:2] or (o[2], o[3]) < (s[2], s[3]))

    kept = [s for s in spans if not any(hidden(s, o) for o in spans)]
    labels = {label for *_, label in kept} | {
        label for label, phrase in licenses.BASE_PHRASES.items() if f" {' '.join(phrase)} " in joined
    }
    base = any(f" {' '.join(phrase)} " in joined for phrase in licenses.BASE_PHRASES.values())
    scores = [licenses.CONFIDENCE[s[2]] for s in kept] + [licenses.CONFIDENCE[licenses.NAME]] * base
    return ",".join(sorted(labels)), max(scores, default=0.0)


@pytest.mark.parametrize("seed", range(2))
def test_containment_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rules = licenses.rules()
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 8)):
            part = _fitting(rng.choice(rules).pattern, rng.random() < 0.5).split()
            if rng.random() < 0.3:  # a beginning or an end only
                cut = rng.randint(0, len(part))
                part = part[:cut] if rng.random() < 0.5 else part[cut:]
            parts += part + [rng.choice(["", "word", "gnu", "under the", "license"])]
        texts.append(" ".join(parts))
    found = _scan(spark, texts)
    assert [(found[i].labels, found[i].score) for i in range(len(texts))] == [_plainly(t) for t in texts]


def test_a_text_of_a_hundred_thousand_signatures(spark):
    n = 100_000
    begin = time.monotonic()
    found = _scan(spark, ["all rights reserved " * n, "GPL 2.0, " * n])
    assert time.monotonic() - begin < 60
    assert (found[0].n_base, found[0].last_word, found[0].labels) == (n, 3 * n - 3, "reserved")
    assert (found[1].n_words, found[1].labels, found[1].score) == (3 * n, "gpl-2.0", 0.8)
