"""Queries that once ran over a part of their table run over all of it, rare cases included."""

from touchline.functions.labels import prepare
from touchline.plans import more_queries  # noqa: F401
from touchline.plans import fixtures as fx
from touchline.plans.queries import QUERIES


def test_labels_of_all_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    made = [(r["doc_id"], prepare(w, "abcdefghijklmnopqrstuvwxyz0123456789", 25)) for r in docs for w in (r["text"] or "").split()]
    assert sorted(map(tuple, QUERIES["c14_label_preparation"](spark, sf).collect())) == sorted(x for x in made if x[1])


def test_median_of_every_track(spark, sf):
    got = QUERIES["a5_median_with_fallback_whole"](spark, sf).collect()
    want = fx.detections(spark, sf).where("track_id is not null").select("seq", "track_id").distinct()
    assert {(r["seq"], r["track_id"]) for r in got} == {tuple(r) for r in want.collect()}
    assert {r["fallback"] for r in got} == {True, False}


def test_sets_of_all_sequences(spark, sf):
    got = QUERIES["o5_set_operations_whole"](spark, sf).collect()
    assert {r["kind"] for r in got} == {"both", "first"} and len({r["seq"] for r in got}) == 20


def test_sides_of_every_track(spark, sf):
    got = QUERIES["j11_return_side_whole"](spark, sf).collect()
    tracks = fx.tracked(spark, sf).select("seq", "track_id").distinct().count()
    assert len({(r["seq"], r[k] // 4) for r in got for k in ("a", "b")}) == tracks
    assert {r["ok"] for r in got} == {True, False}
