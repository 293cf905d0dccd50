"""Means that do not depend on the order of their rows."""

from touchline.operators import audit, tracks

#: In tenths each has a mean of exactly 39; added as doubles one by one, they end at the limit or beyond it by their order.
AT_LIMIT = [[39.0, 41.7, 30.1, 34.8, 49.4], [46.4, 32.2, 39.9, 33.1, 47.1, 35.3], [46.8, 37.8, 40.8, 38.3, 30.1, 49.8, 30.5, 37.9]]

SCHEMA = "seq string, det_id long, track_id long, px double, py double"


def gated(spark, step):
    rows = [("a", 100 * t + k, t, -y, y) for t, ys in enumerate(AT_LIMIT) for k, y in enumerate(ys)]
    return tracks.pitch_gate(spark.createDataFrame(rows[::step], SCHEMA).coalesce(1), 5.0)


def test_a_mean_at_the_limit_stays_in_any_order(spark):
    for step in (1, -1):
        rows = gated(spark, step).collect()
        assert len(rows) == sum(map(len, AT_LIMIT))
        assert {(r["track_id"] == r["track_id_pregate"], r["pitch_mean_x"], r["pitch_mean_y"], r["pitch_gate_offpitch"]) for r in rows} == {(True, -39.0, 39.0, False)}


def test_the_check_of_the_gate_repeats_its_flags(spark):
    out = spark.createDataFrame(gated(spark, 1).collect()[::-1], gated(spark, 1).schema).coalesce(1)
    assert {r["verdict"] for r in audit.pitch_gate(out, 5.0).collect()} == {"PASS"}


def test_values_that_decimals_do_not_hold_have_the_plain_mean(spark):
    big = [(1, 1e300), (1, 3e300), (2, float("inf")), (2, 1.0), (3, None), (4, 9e19), (4, 8e19), (4, -5e19), (5, 0.5), (5, None), (6, float("nan")), (7, 1e-30), (7, 0.0)]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(big, "k int, v double").groupBy("k").agg(tracks.mean(tracks.F.col("v")).alias("m")).collect()}
    assert got[6] != got.pop(6)
    assert got == {1: 2e300, 2: float("inf"), 3: None, 4: 4e19, 5: 0.5, 7: 0.0}
