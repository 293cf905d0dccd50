"""Documents without a doc_id, or with a shared one, go through the pipeline's stages as documents of their own."""

import hashlib
import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from tests.llm.conftest import frame, words

import corpus_pipeline
from touchline.llm import mixing, simhash

STAGES = dict(corpus_pipeline.STAGES)


def texts(df):
    return sorted((str(r["doc_id"]), r["text"]) for r in df.collect())


def test_near_copies_keep_documents_without_an_id(spark):
    rnd = random.Random(11)
    a, b, c = (words(rnd, 120, 4000) for _ in range(3))
    d = [(None, a), (None, b), (None, b), (3, c), (None, c)]
    assert texts(simhash.first_of_each(frame(spark, d))) == sorted([("None", a), ("None", b), ("3", c)])


def test_mix_takes_documents_without_an_id(spark):
    rnd = random.Random(12)
    df = frame(spark, [(None if k % 3 else k, words(rnd, 30)) for k in range(24)])
    taken = sum(r["taken"] for r in mixing.mix(df).collect())
    got = mixing.mixed(df).collect()
    assert sum(len(r["text"].split()) for r in got) == taken
    assert any(r["doc_id"] is None for r in got)


def test_stages_keep_documents_without_an_id(spark, sf):
    rnd = random.Random(13)
    df = frame(spark, [(None if k % 2 else k, words(rnd, 60, 4000)) for k in range(20)])
    near = STAGES["simhash_near_dedup"](spark, df, sf)
    cut = STAGES["suffix_array_dedup"](spark, near, sf)
    assert texts(cut) == texts(near) == texts(df)
    mixed = STAGES["source_mixing"](spark, cut, sf)
    packed = STAGES["packing"](spark, mixed, sf)
    assert mixed.where("doc_id is null").count() > 0
    assert packed.where("doc_id is null").count() > 0


def test_shared_ids_are_paired_with_their_own_share(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a " * 10, "s"), (1, "b " * 20, "s"), (2, "c " * 7, "s"), (2, "c " * 7, "s")], "doc_id long, text string, source string")
    first = mixing.mix

    def fixed(*a, **k):
        # the 10 words are not taken; of the two equal rows one is taken twice, the other not at all
        w = Window.partitionBy("doc_id", "size").orderBy("doc_id")
        rows = first(*a, **k).withColumn("i", F.row_number().over(w))
        return rows.withColumn("taken", F.when((F.col("size") == 10) | (F.col("i") > 1), 0).when(F.col("size") == 7, 14).otherwise(20).cast("long")).drop("i")

    monkeypatch.setattr(mixing, "mix", fixed)
    c = " ".join("c" * 7)
    assert sorted((r["doc_id"], r["text"].strip()) for r in mixing.mixed(df).collect()) == [(1, " ".join("b" * 20)), (2, c), (2, c)]


def test_shared_ids_in_the_mix(spark):
    # the remainder falls inside the rows that share an id: every seed must give the words that it takes
    rows = [(k // 4, f"{w} " * (3 + 5 * k), "ab"[k % 2]) for k, w in enumerate("abcdefghijkl")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(3):
        shares = mixing.mix(df, seed, keyed=True).collect()
        text = {hashlib.md5(t.encode()).digest(): t.split()[0] for _, t, _ in rows}
        want = {text[bytes(r["h"])]: r["taken"] for r in shares if r["taken"]}
        got = {}
        for r in mixing.mixed(df, seed).collect():
            w = r["text"].split()
            got[w[0]] = got.get(w[0], 0) + len(w)
        assert got == want


def test_one_document_of_each_group_where_ids_are_shared(spark):
    rnd = random.Random(14)
    a, b = words(rnd, 120, 4000), words(rnd, 120, 4000)
    near = a + "\n"  # the same words: the same fingerprint
    # 5 leads the group of b; its other text is a near copy of 4's and must go
    assert texts(simhash.first_of_each(frame(spark, [(4, a), (5, near), (5, b), (9, b)]))) == sorted([("4", a), ("5", b)])
    assert len(texts(simhash.first_of_each(frame(spark, [(4, a), (4, near)])))) == 1


def test_columns_with_the_stages_own_names_go_by(spark, sf):
    names = ["doc", "own_id", "least_id", "h", "i", "j", "first", "taken", "size", "_d", "_s", "_k", "th", "row", "spans", "name", "fingerprint"]
    rnd = random.Random(15)
    rows = [(k, words(rnd, 60, 4000), "en", "ab"[k % 2], 1, *(f"{n}{k}" for n in names)) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name in ("simhash_near_dedup", "suffix_array_dedup", "source_mixing"):
        got = STAGES[name](spark, df, sf)
        assert got.columns == df.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in got.collect() for n in names)


def test_documents_without_an_id_spread_over_the_mix(spark):
    rnd = random.Random(16)
    df = frame(spark, [(None, words(rnd, 20)) for _ in range(40)])
    assert len({r["taken"] for r in mixing.mix(df).collect()}) > 1
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))


def test_stages_take_empty_tables(spark, empty, sf):
    docs = empty
    for name in ("simhash_near_dedup", "suffix_array_dedup", "source_mixing", "packing"):
        docs = STAGES[name](spark, docs, sf)
        assert docs.count() == 0
