import zlib

import numpy as np
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import documents, frame

import corpus_pipeline
from touchline.llm import annforest, mixing, packing
from touchline.llm.queries import queries, vocabulary


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_tokenizer_file(spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["", " ", "  a\n\n b", "naïve 漢字 🙂", "<|endoftext|>", "don't 12345 !!"]
    texts += ["a<|endoftext|> b <|endof text|>", "\u0558 \ua7ce\U00010940", " " * 30_000 + "a", "x" * 30_000]
    encode = packing.encoder(vocabulary())
    assert encode.fast is not None
    assert [[*encode(t), 0] for t in texts] == reference_ids(texts)


def test_the_faster_encoder_agrees_on_every_plain_character():
    encode = packing.encoder(vocabulary())
    plain = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and packing.PLAIN.fullmatch(chr(c))]
    texts = [f"a{c}{c}1{c} b {c}!{c}\n{c}{c} " for c in plain]
    assert len(plain) > 30_000
    assert [encode.fast.encode_ordinary(t) for t in texts] == [e.ids for e in encode.exact.encode_batch(texts, add_special_tokens=False)]


def test_packing_of_very_long_runs(spark):
    long = [(1, " " * 2_000_000), (2, "x" * 1_000_000), (None, "a<|endoftext|>b"), (None, None)]
    rows = packing.pack(frame(spark, long), vocabulary(), shard_bytes=1 << 18).collect()
    ids = {(d, len(i)): i for (d, _), i in zip(long, reference_ids([t for _, t in long]), strict=True)}
    for (d, n), want in ids.items():
        pieces = sorted((r for r in rows if r["doc_id"] == d and r["doc_tokens"] == n), key=lambda r: r["start"])
        assert [x for r in pieces for x in np.frombuffer(r["ids"], "<u2").tolist()] == want
    assert len({r["sequence_id"] >> 40 for r in rows}) > 3  # the pieces of a long document are dealt over the shards


def test_packing_round_trip(spark):
    d = documents(1)
    d = d[:-1]  # a repeated row is packed twice; its pieces would have to be told apart here
    rows = packing.pack(frame(spark, d), vocabulary(), shard_bytes=20_000).collect()
    ids = dict(zip([k for k, _ in d], reference_ids([t for _, t in d]), strict=True))
    back, windows = {}, {}
    for r in sorted(rows, key=lambda r: r["start"]):
        back.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u2").tolist())
        assert r["length"] == len(r["ids"]) // 2 and r["doc_tokens"] == len(ids[r["doc_id"]])
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert back == ids
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    digest = packing.digests(packing.pack(frame(spark, d), vocabulary(), shard_bytes=20_000)).collect()
    one = next(r for r in digest if r["doc_id"] == 5 and r["start"] == 0)
    assert one["ids_crc32"] == zlib.crc32(np.array(ids[5][: one["length"]], "<u4").tobytes())


def test_sum_of_squares_minimises():
    rng = np.random.default_rng(3)
    s = packing.SumOfSquares(64)
    for n in rng.integers(1, 64, 500).tolist():
        before = s.level.copy()

        def total(h, n=n, before=before):
            lv = before.copy()
            lv[h] -= h > 0
            if h + n < 64:
                lv[h + n] += 1
            return int((lv[1:64] ** 2).sum())

        open_ = [0, *[h for h in range(1, 64 - n + 1) if before[h] > 0]]
        assert total(s.place(n)) == min(total(h) for h in open_)
        s.add(n, n)
    assert s.level[1:].sum() == sum(len(x) for x in s.open)


def target(sizes, weights):
    goal, left, total = {}, set(sizes), float(sum(sizes.values()))
    while left:
        w = sum(weights[s] for s in left)
        over = [s for s in left if total * weights[s] / w > 3 * sizes[s]]
        if not over:
            return goal | {s: total * weights[s] / w for s in left}
        for s in over:
            goal[s] = 3.0 * sizes[s]
            total -= goal[s]
            left.discard(s)
    return goal


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 5)
    df = frame(spark, documents(2))
    got = mixing.mix(df).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = target(sizes, {s: k % 3 + 1 for k, s in enumerate(names)})
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)
    words = mixing.mixed(df)
    assert words.columns == df.columns
    n = words.select(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))).first()[0]
    assert n == sum(r["taken"] for r in got)


def test_mixing_caps_small_sources(spark):
    rows = [(k, "w " * (100 if k < 20 else 1), f"s{min(k, 20) // 20 + k % 2}") for k in range(24)] + [(99, "one two", "zz"), (98, None, "zero")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    zz = next(r for r in got if r["source"] == "zz")
    assert zz["target"] == 6.0 and zz["taken"] == 6
    assert next(r for r in got if r["source"] == "zero")["taken"] == 0


def vectors(spark, n=3000, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:200] = x[100]  # copies
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)]
    rows += [(n, None, "x"), (n + 20, [0.0] * dim, "x"), (n + 40, [float("nan")] * dim, "x"), (n + 60, [None] * dim, "x"), (n + 80, [1.0], "x"), (n + 100, [float("inf")] * dim, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), x.astype(float)


def recall(df, x):
    got = {}
    for r in annforest.search(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[: min(20, len(x) - 1)]
        mine = [got[q][k + 1] for k in range(len(got[q]))]
        assert all(abs(sc - x[v] @ x[q]) < 1e-9 for v, sc in mine)
        assert all((-a[1], a[0]) <= (-b[1], b[0]) or abs(a[1] - b[1]) < 1e-9 for a, b in zip(mine, mine[1:], strict=False))
        hit += len({v for v, _ in mine} & set(best.tolist()))
        total += len(best)
    assert set(got) == set(range(0, len(x), 20))
    return hit / total


def test_ann_recall(spark):
    assert recall(*vectors(spark)) >= 0.9


def test_ann_looks_at_few_rows_where_neighbours_are_near(spark, monkeypatch):
    monkeypatch.setattr(annforest, "SHARD_ROWS", 4000)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(200, 24)), 60, 0) + 0.05 * rng.normal(size=(12_000, 24))
    df = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    assert recall(df, x) >= 0.9
    r = annforest.stats(df).first()
    assert (r["queries"], r["shards"]) == (600, 3) and r["share"] < 0.15


def test_ann_ties_go_to_the_smaller_id(spark):
    # 60 vectors tie for the places of query 0 and 300 more lie behind them
    rng = np.random.default_rng(5)
    x = np.concatenate([np.eye(64)[[0]], [np.eye(64)[0] + np.eye(64)[1 + k] for k in range(60)], rng.normal(size=(300, 64)) * 0.01])
    ids = [0, *rng.permutation(np.arange(1, 61)).tolist(), *range(1001, 1600, 2)][: len(x)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in annforest.search(df).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(k, k) for k in range(1, 21)]


def test_the_ascent_offers_what_shares_prefixes():
    rng = np.random.default_rng(6)
    f = annforest.Forest(rng.normal(size=(300, 16)))
    q = rng.normal(size=(3, 16))
    h = annforest.strings(q, f.planes)
    lo, hi = f.ranges(h)
    for i in range(3):
        for s in range(annforest.SYMBOLS + 1):
            shift = f.bits * (annforest.SYMBOLS - s)
            assert (hi[i, :, s] - lo[i, :, s]).tolist() == ((f.h >> shift) == (h[i] >> shift)).sum(0).tolist()
    steps = f.offered((hi - lo).astype(np.int64))
    assert (np.diff(steps, axis=1) >= 0).all() and (steps[:, -1] == 300 * annforest.TREES).all()


def test_ann_small_table_is_exact(spark):
    assert recall(*vectors(spark, 260)) == 1.0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in annforest.search(few).orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert annforest.search(few.where("false")).count() == 0


def test_empty_tables(empty):
    assert packing.pack(empty, vocabulary()).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(empty).count() == 0


def test_pipeline_against_brute_force(spark, sf, monkeypatch):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages["toxicity"](spark, docs, sf)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    near = stages["simhash_near_dedup"](spark, kept, sf)
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(d for d, _, c in brute.simhash_components(rows) if d == c)
    cut = stages["suffix_array_dedup"](spark, near, sf)
    assert cut.columns == docs.columns and cut.count() == near.count()
    want = {d: (n - r, spans) for d, n, r, spans, _ in brute.suffix_dedup([(r["doc_id"], r["text"]) for r in near.collect()], corpus_pipeline.PASSAGE)}
    # a cut inside a character leaves up to three stray bytes on either side, which go
    assert all(want[r["doc_id"]][0] - 6 * want[r["doc_id"]][1] <= len(r["text"].encode()) <= want[r["doc_id"]][0] for r in cut.collect())
    mixed = stages["source_mixing"](spark, cut, sf)
    assert mixed.columns == docs.columns
    packed = stages["packing"](spark, mixed, sf)
    ids = packed.groupBy().agg(F.sum("length")).first()[0]
    assert ids == sum(len(x) for x in reference_ids([r["text"] for r in mixed.collect()]))


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
