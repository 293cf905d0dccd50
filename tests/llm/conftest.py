import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, a string, row string, spans string, key string, rank int, score double, th long"


def words(rnd, n, vocab=400):
    return " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))


def documents(seed=1):
    """Texts with copies, near copies, shared passages, nulls, empties, ties and repeated rows."""
    rnd = random.Random(seed)
    passage = words(rnd, 140)
    out = [None, "", "  \n\t ", "one", "Two words", "x " * 300, "é" * 900, "ab" * 1000]
    for i in range(30):
        t = words(rnd, rnd.randint(1, 300))
        if i % 5 == 0:
            cut = rnd.randint(0, len(t))
            t = t[:cut] + " " + passage + " " + t[cut:]
        out.append(t)
        if i % 4 == 0:
            out.append(t)
        if i % 6 == 0:
            w = t.split()
            w[len(w) // 2] = "changed"
            out.append(" ".join(w))
    out.append("\n".join(words(rnd, 9) for _ in range(40)))
    out.append(words(rnd, 20_000, 5000))
    rows = [(k, t) for k, t in enumerate(out)]
    rows.append(rows[10])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, documents())


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


def frame(spark, rows):
    langs, sources = ["en", "de", "fr", "es", None], ["s0", "s0", "s1", None]
    full = [(d, t, langs[k % 5], sources[k % 4], len(t or ""), 1, "a", "r", None, "k", 1, 0.5, 7) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)
