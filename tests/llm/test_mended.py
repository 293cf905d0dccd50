"""Cases that earlier versions got wrong."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from tests.llm import brute
from tests.llm.conftest import documents, frame

from touchline.llm import html, langid, quality, suffixdedup, toxicity

BODY = "The first paragraph of this page says enough for a reader to go on, with words of its own and no links at all in it."


@pytest.mark.parametrize("raw", ["<script src=/js/>var a=1; leak</script>", "<style media=/x/>p {leak: 1}</style>", "<script src=a.js />leak()</script>", "<iframe src=/ads/>leak</iframe>", "<textarea name=/a/>leak</textarea>"])
def test_raw_elements_have_no_empty_form(raw):
    got = html.main_text(f"<html><head><title>t</title></head><body><article><p>{BODY}</p>{raw}<p>{BODY} Again.</p></article></body></html>", html.trained())
    assert "leak" not in got and got.count(BODY) == 2


@pytest.mark.parametrize("slug", ["modal-logic", "comments-on-method", "related-work", "navigation-of-ships", "advertising-in-1900", "share-prices"])
def test_slugs_of_headings_are_not_furniture(slug):
    page = f"<html><body><article><h1>Title of it</h1><section id='{slug}'><h2>A part of it</h2><p>{BODY}</p></section><h2 id='{slug}'>Next part</h2><p>{BODY} More.</p></article></body></html>"
    got = html.main_text(page, html.trained())
    assert got.count(BODY) == 2 and "Next part" in got


def test_ids_of_furniture_still_count():
    page = f"<html><body><article><p>{BODY}</p><div id='comments-section'><p>Reply by a reader: {BODY[:40]}</p></div><div id='site-footer'><p>Imprint of the site</p></div></article></body></html>"
    assert html.main_text(page, html.trained()) == BODY


def test_math_inside_a_paragraph_stays():
    got = html.main_text(f"<html><body><article><p>The formula <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds. {BODY}</p></article></body></html>", html.trained())
    assert got == f"The formula x+1 holds. {BODY}"


@pytest.mark.parametrize("window", [64, 200])
def test_shorter_windows_equal_brute_force(spark, window):
    d = documents(7)
    got = sorted((tuple(r) for r in suffixdedup.digests(frame(spark, d), window).collect()), key=str)
    assert got == brute.suffix_dedup(d, window)


def test_removed_passages_of_over_fifty_words_at_the_pipelines_window(spark):
    import corpus_pipeline

    rnd = random.Random(8)
    own = lambda k, n: " ".join(f"{k}v{rnd.randrange(10**6)}" for _ in range(n))
    passage = " ".join(rnd.choice(["the", "port", "cat", "of", "seven", "rain", "to"]) for _ in range(52))
    assert corpus_pipeline.PASSAGE <= len(passage) < 300
    d = [(k, f"{own(k, 60)} {passage} {own(k, 60)}") for k in range(6)] + [(9, own(9, 100))]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, frame(spark, d), "").collect()}
    assert all(passage not in t for t in got.values()) and got[9] == d[-1][1]


def test_a_long_text_does_not_end_the_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    rows = [(k, ("vile slur " if k % 2 else "kind words ") * (10 if k % 16 else 4000) + f" n{k}", "en", "s", 1) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    held = []
    monkeypatch.setattr(toxicity, "train", lambda sample, share: held.extend(sample.collect()) or {"index": None, "b": 0.5})
    toxicity.fitted(docs, labels)
    for c in (0, 1):
        own = [r["t"] for r in held if r["y"] == c]
        assert sum(map(len, own)) <= 20_000 and len(own) > 80


def test_toxicity_equals_a_dictionary_version(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice(["vile", "Scum!", "träge", "ßü", "you"] if k % 2 and rnd.random() < 0.4 else ["fine", "day", "träge", "Sun\n", "ßü"]) for _ in range(rnd.randint(0, 25)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)

    def hashed(gram):
        h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        for c in gram:
            h = (h * (0x01000193 * 2 + 1) & 0xFFFFFFFF) ^ ord(c)
        h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - toxicity.BITS

    def has(text):
        t = "".join(" " if c in " \t\n\v\f\r" else c.lower() if "A" <= c <= "Z" else c for c in text)
        return {hashed(t[i : i + n]) for n in toxicity.ORDERS for i in range(len(t) - n + 1)}

    fit = [(k, t) for k, t in rows if t and zlib.crc32(str(k).encode()) % 5]
    seen = [Counter(h for k, t in fit if k % 2 == c for h in has(t)) for c in (0, 1)]
    n = [sum(k % 2 == c for k, _ in fit) + 2 for c in (0, 1)]
    z = {}
    for h in seen[0].keys() | seen[1].keys():
        a, b = seen[1][h] + 1, seen[0][h] + 1
        p = (a + b) / sum(n)
        z[h] = abs(a / n[1] - b / n[0]) / math.sqrt(p * (1 - p) * (1 / n[1] + 1 / n[0]) + 1e-12)
    best = sorted((h for h in z if z[h] > 2), key=lambda h: (-round(z[h], 9), h))[: toxicity.FEATURES]
    assert sorted(best) == [int(h) for h in (model["index"] >= 0).nonzero()[0]] and len(best) > 20
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    for k, t in rows:
        total = model["b"] + sum(model["w"][model["index"][h]] for h in has(t) if model["index"][h] >= 0)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
    assert sum((got[k] >= 0.5) == bool(k % 2) for k, t in rows if t) > 230


def test_language_fit_skips_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 40_000)
    rows = [(k, ("guten morgen " if k % 2 else "good morning ") * (3 if k % 8 else 9000), "de" if k % 2 else "en", "s", 1) for k in range(200)]
    held = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: held.append((texts, langs)) or None)
    langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    texts, langs = held[0]
    assert sum(map(len, texts)) <= 40_000 and {"de", "en"} == set(langs) and len(texts) > 100


def test_the_line_limit_is_reached(spark, sf):
    assert quality.rules(spark.read.parquet(f"{sf}/documents.parquet")).where("n_boiler_words > 0").count() >= 0
    rows = [(k, f"same line here\n{' '.join(f'w{k}x{i}' for i in range(30))}") for k in range(quality.LINE_DOCS + 1)]
    df = spark.createDataFrame([(k, t, "h") for k, t in rows], "doc_id long, text string, source string")
    assert {r["n_boiler_words"] for r in quality.rules(df).collect()} == {3}
    assert {r["n_boiler_words"] for r in quality.rules(df.where("doc_id > 0")).collect()} == {0}


def test_comments_without_a_class_go_and_talk_in_an_article_stays():
    tree = html.trained()
    text = f"<h1>A title of a page</h1><p>{BODY}</p><p>{BODY} Second.</p>"
    comments = f"<h3>2 comments</h3><p>Reply by Ann</p><p>I liked it a lot, thank you for it.</p><p>Ben says:</p><p>{BODY[:60]}</p>"
    assert html.main_text(f"<body>{text}{comments}</body>", tree) == f"A title of a page\n{BODY}\n{BODY} Second."
    talk = f"<p>Ann says:</p><p>I liked it a lot, thank you for it.</p>"
    assert "Ann says:\nI liked it" in html.main_text(f"<body><article>{text}{talk}</article></body>", tree)


def test_word_counts_are_whole_and_neighbours_decide_where_no_article_tells():
    tree = html.trained()
    pages = [p for p in html.LAYOUTS if "<article" not in p and "<main" not in p]
    changed = wrong = n = 0
    for page in pages:
        got = html.blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))
        for block, row in zip(got, html.features(got), strict=True):
            alone = (*row[:2], 0, 0.0, 0, 0.0, *row[6:])
            kept, blind = html.decide(tree, row) >= 0.5, html.decide(tree, alone) >= 0.5
            n += 1
            changed += kept != blind
            wrong += blind != (block[0][0] == "+")
    assert changed >= 5 and wrong >= 5
    long = html.blocks(f"<p>{'word ' * 500}</p>")
    assert html.features(long)[0][0] == 500


def test_op4_shows_what_is_left(spark):
    import hashlib

    from touchline.llm.queries import op4_suffix_dedup

    got = op4_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"} <= set(got[0].asDict())
    whole = [r for r in got if len(r["text"].encode()) == r["n_bytes"] - r["n_removed"]]  # no character was cut
    assert any(r["n_removed"] for r in whole) and any(not r["n_removed"] for r in whole)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in whole)
    assert all(0 <= r["n_bytes"] - r["n_removed"] - len(r["text"].encode()) <= 6 * r["n_spans"] for r in got)
