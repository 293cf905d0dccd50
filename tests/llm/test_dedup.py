import random

import numpy as np
import pytest
from tests.llm import brute
from tests.llm.conftest import documents, frame

from touchline.llm import anchored, fmdedup, simhash, suffixdedup


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_brute_force(spark, seed):
    d = documents(seed)
    got = rows(suffixdedup.digests(frame(spark, d)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(d)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, seed):
    d = documents(seed)
    got = rows(fmdedup.digests(frame(spark, d)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(d)


def test_hot_buckets_are_dealt_by_windows(spark, monkeypatch):
    rnd = random.Random(5)
    passage = " ".join(f"p{rnd.randrange(90)}" for _ in range(150))
    d = [(k, f"{' '.join(f'w{rnd.randrange(900)}' for _ in range(rnd.randint(5, 60)))} {passage} {' '.join(f'v{rnd.randrange(900)}' for _ in range(rnd.randint(0, 60)))}") for k in range(40)]
    monkeypatch.setattr(anchored, "HOT", 5)
    assert rows(suffixdedup.digests(frame(spark, d)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_dedup(d)
    assert rows(fmdedup.digests(frame(spark, d)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(d)


def test_texts_that_share_an_id_are_told_apart(spark):
    rnd = random.Random(6)
    t = " ".join(f"w{rnd.randrange(900)}" for _ in range(200))
    d = [(1, t), (1, "other " * 30), (2, t), (None, t)]
    got = rows(suffixdedup.digests(frame(spark, d)), "doc_id", "n_removed")
    assert sum(n == len(t) for _, n in got) == 3


def test_simhash_equals_brute_force(spark):
    d = [x for x in documents(3) if x[0] is not None]
    got = simhash.components(frame(spark, d)).collect()
    assert sorted((r["doc_id"], f"{r['fingerprint'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got) == brute.simhash_components(d)


def test_simhash_links_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    f = [base]
    for _ in range(3):
        x = base.copy()
        for _ in range(4):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
        f.append(x)
    f = np.unique(np.concatenate(f))
    monkeypatch.setattr(simhash, "SHARD_GOAL", 20)
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 100)
    edges = simhash.link(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), len(f)).collect()
    at = {int(x): k for k, x in enumerate(f.view(np.int64))}
    mine, want = simhash.Forest(len(f)), simhash.Forest(len(f))
    mine.join(np.array([at[e["a"]] for e in edges]), np.array([at[e["b"]] for e in edges]))
    simhash.compare(f, np.arange(len(f)), np.arange(len(f)), want)
    assert (mine.up == want.up).all()
    assert (want.up != np.arange(len(f))).sum() > 500


def test_empty_tables(empty):
    assert suffixdedup.digests(empty).count() == 0
    assert fmdedup.digests(empty).count() == 0
    assert simhash.components(empty).count() == 0


def test_difference_cover_and_suffix_order():
    cover = set(suffixdedup.COVER.tolist())
    v = suffixdedup.V
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    rng = np.random.default_rng(0)
    t = rng.integers(97, 99, 300).astype(np.uint8)
    sa = fmdedup.suffix_array(t.astype(np.int64))
    raw = t.tobytes()
    assert sa.tolist() == sorted(range(300), key=lambda i: raw[i:])


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    t = np.append(rng.integers(1, 5, 500), 0)
    index = fmdedup.FMIndex(t)
    pattern = rng.integers(1, 6, 60)
    length, lo, hi = index.matches(np.minimum(pattern, 4), np.arange(6, 61), 6)
    s = "".join(map(str, t))
    for e, n, a, b in zip(range(6, 61), length, lo, hi, strict=True):
        p = "".join(map(str, np.minimum(pattern, 4)[e - 6 : e]))
        best = max(k for k in range(7) if p[6 - k :] in s)
        assert n == best
        assert b - a == sum(s.startswith(p[6 - n :], i) for i in range(len(s))) if n else True


@pytest.mark.parametrize("most", [1, 2, 5, 12])
def test_hot_buckets_are_narrowed_first(spark, monkeypatch, most):
    # one passage with other words in its middle, before and behind: buckets of many distinct blocks at every length of context
    rnd = random.Random(8)
    passage = [f"p{rnd.randrange(90)}" for _ in range(160)]
    d = []
    for k in range(36):
        t = list(passage)
        t[rnd.choice((30, 80, 81, 130))] = f"x{k % 9}"
        d.append((k, " ".join([*(f"w{rnd.randrange(900)}" for _ in range(rnd.randint(0, 40))), *t, *(f"v{rnd.randrange(900)}" for _ in range(rnd.randint(0, 40)))])))
    monkeypatch.setattr(anchored, "HOT", most)
    assert rows(suffixdedup.digests(frame(spark, d)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_dedup(d)
    assert rows(fmdedup.digests(frame(spark, d)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(d)


def test_narrowed_blocks_keep_their_windows():
    import pyarrow as pa

    window, gram = 12, 3
    raw = bytes(range(40))
    b = pa.RecordBatch.from_pydict({"a": [1], "b": [1], "base": [5], "n": [9], "d": [8], "raw": [raw[: 9 - 1 + window]]})
    for v in (1, 2, 4):
        out = next(anchored.narrowed(v, gram, window, 1)([b])).to_pylist()
        got = [(r["base"] + k, r["raw"][k : k + window], r["d"] - k) for r in out for k in range(r["n"])]
        assert got == [(5 + k, raw[k : k + window], 8 - k) for k in range(9)]
        assert len({r["b"] for r in out}) == len(out)
