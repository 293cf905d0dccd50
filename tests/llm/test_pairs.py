"""Alignment, divergence and cap filters against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import documents, frame

from touchline.llm import alignment, capfilters, divergence
from touchline.llm.packing import byte_symbols

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts):
    """Token by token, in Python."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    symbols = byte_symbols()
    found = []
    for t in texts:
        a = one.encode(" " + t, add_special_tokens=False) if t else None
        a = [(k, bytes(symbols[c] for c in one.id_to_token(k))) for k in a.ids] if t else []
        b = [(k, bytes([int(two.id_to_piece(k)[3:5], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode()) for k in two.encode(t)] if t else []
        want = (" " + t).encode() if t else b""
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        ends = []
        for side in (a, b):
            at, out = 0, {}
            for k, (i, x) in enumerate(side):
                at += len(x)
                out[at] = (k, i)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            p, q = ends[0][c][0] + 1, ends[1][c][0] + 1
            groups.append(",".join(str(k) for k, _ in a[i:p]) + "|" + ",".join(str(k) for k, _ in b[j:q]))
            i, j = p, q
        found.append((len(a), len(b), len(groups), [(ends[0][c][1], ends[1][c][1]) for c in cuts], hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(x for f in found for x in f[3])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(n_a, n_b, n, len(li), sum(counts[x] == top[x[1]] for x in li), sum(counts[x] for x in li), sha) for n_a, n_b, n, li, sha in found]


ODD = [
    None, "", " ", "  two  spaces ", "<|endoftext|> and </s> and <s> as text", "▁ bar", "tab\tand\nline\r\n", "a\u0000b", "café naïve 你好 \U0001f600\U0001f600", "é combining", "ﬁ ligature   nbsp",
    "x" * 30_000, " " * 5000, "word " * 4000, "퟿", "​‍ zero width", "1234567890 3.14159 don't I'LL",
]


def test_alignment_equals_token_by_token(spark, monkeypatch):
    texts = ODD + [t for _, t in documents(4)][:40]
    monkeypatch.setattr(alignment, "RUN", 4096)
    want = plain_alignment(texts)
    got = alignment.alignment(frame(spark, list(enumerate(texts))), A, B).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r["doc_id"])] == want


def test_alignment_by_shuffle_equals_broadcast(spark, docs, monkeypatch):
    one = sorted(map(tuple, alignment.alignment(docs, A, B).collect()), key=str)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert sorted(map(tuple, alignment.alignment(docs, A, B).collect()), key=str) == one


def test_alignment_of_shared_and_missing_ids_and_of_no_rows(spark, empty):
    got = alignment.alignment(frame(spark, [(1, "same text"), (1, "same text"), (None, "other"), (2, None)]), A, B).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_a"] > 0) for r in got) == [(False, 1, True), (False, 1, True), (False, 2, False), (True, 0, True)]
    assert alignment.alignment(empty, A, B).count() == 0


def plain_audit(rows, least=10):
    docs = [(la or "", s or "", ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for la, s, t in rows]
    out = []
    for la in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == la]
        held = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in held.items() if n >= least)
        groups = {s: Counter(w for d in own if d[1] == s for w in d[2] if held[w] >= least) for s in {d[1] for d in own}}
        lang = sum(groups.values(), Counter())

        def p(c, w, v=len(kept)):
            return 1 + math.floor(Fraction(10**9 * (c[w] + 2), sum(c.values()) + 2 * v))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s, c in groups.items():
            pairs = [(sum(f(p(c, w), p(groups[t], w)) for w in kept), t) for t in groups if t != s]
            marked = [(f(p(c, w), p(lang, w)), w) for w in kept if c[w] and p(c, w) > p(lang, w)]
            for part, found, most in (("pair", pairs, None), ("term", marked, 10)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((la, s, part, item, v, rank))
    return sorted(out)


def corpus(spark, n=160):
    rnd = random.Random(3)
    names = ["s", "é", "zz", None, "quiet"]
    rows = []
    for k in range(n):
        la = rnd.choice(["en", "de", None, "rare"] if k % 40 == 0 else ["en", "de", None])
        s = rnd.choice(names[:4])
        t = " ".join(rnd.choice(["Word%s", "w%sÉ", "%s1a2", "_x%sy"]) % "abcdefgh"[min(7, int(rnd.expovariate(0.4 + 0.2 * names.index(s))))] for _ in range(rnd.randint(0, 60)))
        rows.append((la, s, None if k % 17 == 0 else t))
    rows += [("en", "quiet", "123 !!"), ("en", "quiet", None), ("en", "s", "\U00010400 ￿ A" * 3), *[("en", "s", "Word")] * 3, ("solo", "only", "word " * 50)]
    return rows, spark.createDataFrame([(k, t, la, s, 1, 2) for k, (la, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term int")


def test_divergence_equals_plain_version(spark):
    rows, df = corpus(spark)
    assert sorted(map(tuple, divergence.audit(df).collect())) == plain_audit(rows)


def test_divergence_in_small_runs_equals_plain_version(spark, monkeypatch):
    rows, df = corpus(spark)
    monkeypatch.setattr(divergence, "CHUNK", 200)
    monkeypatch.setattr(divergence, "CELLS", 5)
    assert sorted(map(tuple, divergence.audit(df.repartition(7)).collect())) == plain_audit(rows)


def test_divergence_shuffles_its_counts_once(spark, monkeypatch):
    rows, df = corpus(spark)
    own = df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    assert divergence.kept_counts(own)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(divergence, "CHUNK", 200)
    monkeypatch.setattr(divergence, "ROWS", 64)
    monkeypatch.setattr(divergence, "GROUPS", 0)
    assert sorted(map(tuple, divergence.audit(df).collect())) == plain_audit(rows)


def test_divergence_of_no_rows_and_of_no_kept_terms(spark, empty):
    assert divergence.audit(empty).count() == 0
    df = spark.createDataFrame([("a b", "en", "s"), ("c", "en", "t")], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_histogram_holds_every_term_once(spark):
    _, df = corpus(spark)
    a = divergence.Audit(df)
    pairs = a.pairs()
    got = a.histogram(pairs).groupBy("lang", "s", "t").agg({"m": "sum", "x": "max"}).join(pairs, ["lang", "s", "t"]).collect()
    assert got and all(r["sum(m)"] == r["size"] for r in got)


def plain_clusters(rows, limit=0.93):
    n = len(rows)
    x = [np.array(v, float) if v and la is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) else None for _, v, la in rows]
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= limit:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)].append(rows[i][0])
    out = []
    for i in range(n):
        c = min(least[root(i)], default=None)
        out.append((rows[i][0], links[i], c, c is None if rows[i][0] is None else rows[i][0] == c))
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, la, 1, 2, "x") for k, v, la in rows], "vec_id long, embedding array<float>, label int, n long, p long, root string")


def tilted(rng, x, cosine):
    """A vector at this cosine from x."""
    y = rng.normal(size=len(x))
    u = x / np.linalg.norm(x)
    if len(x) == 1:
        return u
    y -= (y @ u) * u
    return u * cosine + y / np.linalg.norm(y) * math.sqrt(1 - cosine * cosine)


def sample(seed, n=150, dims=24):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(n):
        x = rng.normal(size=dims)
        near = [x] + [tilted(rng, x, c) for c in rng.uniform(0.85, 1, rng.integers(0, 4))]
        for y in near:
            rows.append((k, y.astype(np.float32).tolist(), int(rng.integers(0, 3)) if rng.random() < 0.1 else 0))
            k += 1
    centre = rng.normal(size=dims)
    rows += [(k + j, (centre + rng.normal(size=dims) * 0.15).astype(np.float32).tolist(), 1) for j in range(60)]
    k += 60
    odd = [None, [], [0.0] * dims, [1.0] * (dims - 1) + [None], [1.0] * (dims - 1) + [float("nan")], [1.0] * (dims - 1) + [float("inf")], [1.0] * 5, [2.0] * 5, [3e38] * dims, [1e-38] * dims, [1.0] * dims, [-0.0] + [1.0] * (dims - 1), [0.0] + [1.0] * (dims - 1)]
    rows += [(k + j, v, 2) for j, v in enumerate(odd)]
    rows += [rows[0], rows[0], (None, rows[0][1], rows[0][2]), (k + 50, [1.0] * dims, None), (None, [5.0, -1.0], 9)]
    return rows


@pytest.mark.parametrize(("seed", "dims"), [(1, 24), (2, 24), (3, 3), (4, 1), (5, 130)])
def test_cap_filters_equal_brute_force(spark, seed, dims):
    rows = sample(seed, 150 if dims > 3 else 30, dims)
    if dims == 1:
        rows = [r for r in rows if r[0] is None or r[1] is None or len(r[1]) < 2]
    assert sorted(map(tuple, capfilters.clusters(vectors(spark, rows)).collect()), key=str) == plain_clusters(rows)


def test_cap_filters_cut_into_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "BLOCK", 7)
    monkeypatch.setattr(capfilters, "POPULAR", 2)
    rows = sample(6, 60)
    assert sorted(map(tuple, capfilters.clusters(vectors(spark, rows)).collect()), key=str) == plain_clusters(rows)


def test_cap_filters_of_no_rows(spark):
    assert capfilters.clusters(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [3, 4, 5])
def test_pairs_at_the_limit_share_a_filter(blocks):
    rng = np.random.default_rng(blocks)
    x = rng.normal(size=(1500, 64))
    y = np.array([tilted(rng, v, capfilters.COSINE) for v in x])
    missed, listed = np.ones(len(x), bool), 0
    for t in range(capfilters.TURNS):
        code = capfilters.Code(64, blocks, t)
        found = []
        for v in (x, y):
            row, c = code.decode(v / np.linalg.norm(v, axis=1, keepdims=True))
            found.append({(int(r), int(k)) for r, k in zip(row, c, strict=True)})
        listed += len(found[0])
        missed[[r for r, _ in found[0] & found[1]]] = False
    assert missed.sum() <= 1
    assert 0.5 * capfilters.LIST < listed / len(x) < 5 * capfilters.LIST


def test_decoding_finds_every_direction_above_the_limit():
    rng = np.random.default_rng(0)
    code = capfilters.Code(16, 2, 0)
    x = rng.normal(size=(20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, c = code.decode(x, 0.2)
    z = (x @ code.rotation).reshape(20, 2, 8)
    want = {(i, a * 32 + b) for i in range(20) for a in range(32) for b in range(32) if z[i, 0] @ code.words[0, a] + z[i, 1] @ code.words[1, b] >= 0.2}
    assert set(zip(row.tolist(), c.tolist(), strict=True)) == want
