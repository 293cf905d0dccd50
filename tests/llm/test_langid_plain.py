"""Language votes against a version with dictionaries and Python floats."""

import math
import random

import pytest

from touchline.llm import langid


def hashed(gram: bytes) -> int:
    h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
    for c in gram:
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
    h ^= h >> 15
    return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - langid.BITS


def histogram(text: str) -> dict:
    raw = bytes(32 if b in b" \t\n\v\f\r" else 48 if 48 <= b < 58 else b + 32 if 65 <= b < 91 else b for b in text.encode())
    seen: dict[int, int] = {}
    for n in langid.ORDERS:
        for i in range(len(raw) - n + 1):
            h = hashed(raw[i : i + n])
            seen[h] = seen.get(h, 0) + 1
    norm = math.sqrt(sum(seen.values()))
    return {h: math.sqrt(v) / norm for h, v in seen.items()}


def soft(z: float) -> float:
    return 1 / (1 + math.exp(-4 * z))


def plain(model: dict, text: str) -> tuple[str, float]:
    x = histogram(text)
    best, trust = 0, 1.0
    if model["top"] is not None:
        w, b = model["top"]
        z = [b[k] + sum(v * w[h, k] for h, v in x.items()) for k in range(len(b))]
        best = max(range(len(z)), key=lambda k: (z[k], -k))
        first, second = sorted(z, reverse=True)[:2]
        trust = soft(first - second)
    votes = dict.fromkeys([k for k, f in enumerate(model["family"]) if f == best], 0.0)
    margins = {}
    for a, b, w, c in model["pairs"]:
        z = c + sum(v * w[h] for h, v in x.items())
        margins[a, b] = z
        if a in votes:
            votes[a] += (z >= 0) + soft(z) * 1e-3
            votes[b] += (z < 0) + (1 - soft(z)) * 1e-3
    lang = max(votes, key=lambda k: (votes[k], -k))
    near = min([1.0, *(soft(z) for (a, _), z in margins.items() if a == lang), *(soft(-z) for (_, b), z in margins.items() if b == lang)])
    return model["codes"][lang], trust * near


def test_votes_equal_a_dictionary_version(spark):
    rnd = random.Random(2)
    vocabulary = {"en": "the and of with that", "de": "der und von mit dass ßü", "nl": "de het van met dat ij", "fr": "le et de avec que é", "es": "el y del con que ñ", "fi": "ja on että ä"}
    rows = [(k, " ".join(rnd.choice(vocabulary[la].split() + ["X1", "99", "mixed"]) for _ in range(rnd.randint(1, 30))), la) for k, la in enumerate(rnd.choice(sorted(vocabulary)) for _ in range(260))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fitted(df)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df).collect()}
    for k, text, _ in rows:
        lang, score = plain(model, text) if any(c.isalpha() for c in text) else ("und", 0.0)
        assert got[k] == (lang, pytest.approx(score, abs=1e-9))
    assert sum(got[k][0] == la for k, _, la in rows) > 200
