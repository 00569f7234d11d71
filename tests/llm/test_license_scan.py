"""The licence scan against a comparison of every template with every start."""

import random
import re

import pytest

from plumbline.llm import license_scan
from plumbline.llm.license_scan import TEMPLATES, Index, Template, key_places


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_spans(text, index):
    """All (label, base, start, share) by brute force over starts."""
    words, out = words_of(text), set()
    for t, weights in zip(index.templates, index.weights):
        own, keys = words_of(t.text), set(key_places(t))
        for start in range(-len(own), len(words)):
            same = [j for j in range(len(own)) if 0 <= start + j < len(words) and words[start + j] == own[j]]
            weight = sum(weights[j] for j in same)
            if keys <= set(same) and 5 * weight >= 4 * sum(weights):
                out.add((t.label, t.base, start, weight / sum(weights)))
    return out


def noisy(rng):
    """A notice with a few words changed, lost or added, between other words."""
    words = words_of(rng.choice(TEMPLATES).text)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], ["other"], [words[at], "more"], [words[at].upper()]]) or ["x"]
    around = [[rng.choice(["the", "of", "license", "w1", "w2", "é"]) for _ in range(rng.randint(0, 6))] for _ in range(2)]
    return rng.choice([" ", ", ", "\n"]).join([*around[0], *words, *around[1]])


def test_against_every_start(spark, make_docs, odd_texts):
    rng = random.Random(5)
    texts = [noisy(rng) for _ in range(250)] + [" ".join(noisy(rng) for _ in range(4)) for _ in range(30)] + odd_texts
    texts += ["cc by cc by cc", "All  rights\nreserved. ALL RIGHTS RESERVED", "allrights reserved", "rights reserved", "general public licensE"]
    got = {r["doc_id"]: r for r in license_scan.scanned(make_docs(texts)).collect()}
    vocabulary = {w for t in TEMPLATES for w in words_of(t.text)}
    df = {w.encode(): sum(w in words_of(t) for t in texts) for w in vocabulary}
    index = Index(TEMPLATES, len(texts), df)
    for number, text in enumerate(texts):
        assert got[number]["n_words"] == len(words_of(text))
        assert {(s["label"], s["base"], s["start"], s["share"]) for s in got[number]["spans"]} == plain_spans(text, index), text
    assert sum(len(r["spans"]) > 0 for r in got.values()) > 100


def test_summary_of_odd_rows(spark, make_docs):
    rows = [(1, "x cc by y cc-by all rights reserved"), (1, "x cc by y cc-by all rights reserved"), (None, "general public license"), (2, None), (3, ""), (4, "plain")]
    got = sorted((tuple(r) for r in license_scan.summarised(license_scan.scanned(make_docs(rows))).collect()), key=str)
    one = (1, 9, 3, 1, 6, "cc-by,reserved", "cc-by,reserved", 1.0)
    rest = [(None, 3, 1, 0, 0, "gpl", "gpl", 1.0), *((i, n, 0, None, None, "", "", 0.0) for i, n in ((2, 0), (3, 0), (4, 1)))]
    assert got == sorted([one, one, *rest], key=str)
    assert license_scan.scanned(make_docs([])).collect() == []


@pytest.mark.parametrize("part", [1, 7, 40])
def test_parts_of_a_long_text_change_nothing(monkeypatch, part):
    rng = random.Random(6)
    index = Index(TEMPLATES, 100, {})
    for _ in range(30):
        text = " ".join(noisy(rng) for _ in range(6))
        monkeypatch.setattr(license_scan, "TEXT_PART", 1 << 20)
        whole = index.spans(text.encode())
        monkeypatch.setattr(license_scan, "TEXT_PART", part)
        assert index.spans(text.encode()) == whole


def test_a_key_phrase_belongs_to_its_template():
    with pytest.raises(ValueError):
        key_places(Template("a", "some words", ("other",)))
