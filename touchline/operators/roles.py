"""Roles and sides of trajectories: assistants, keepers, main referee, then team names, as windows and aggregates per sequence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.tracks import BOX_X, BOX_Y


@dataclass(frozen=True)
class Params:
    tau_n: int = 5
    tau_a: float = 0.85
    tau_a_sy: float = 3.0
    tau_m: float = 0.30
    confirm: str = "outlier"
    side_rule: str = "keeper"
    band: float = 0.9


def _sequence() -> Window:
    return Window.partitionBy("seq")


def accepted(margin: Column, p: Params) -> Column:
    return F.lit(True) if p.confirm != "outlier" else F.col("cluster").isNull() | (margin >= p.tau_m)


def assistants(t: DataFrame, p: Params) -> DataFrame:
    """The farthest eligible trajectory of either side line; ``assist`` holds those that are confirmed."""
    top = F.max(F.abs("my")).over(_sequence())
    cand = (F.col("n") >= p.tau_n) & (F.abs("my") >= p.tau_a * top) & (F.col("sy") <= p.tau_a_sy)
    t = t.withColumn("_top", top).withColumn("_cand", F.coalesce(cand, F.lit(False))).withColumn("_sign", F.signum("my"))
    first = F.row_number().over(Window.partitionBy("seq", "_sign", "_cand").orderBy(F.abs("my").desc(), "track_id")) == 1
    # a mean of exactly zero has no side and is never thinned out
    t = t.withColumn("_cand", F.col("_cand") & (first | (F.col("_sign") == 0)))
    margin = F.abs("my") / (F.col("_top") + 1e-9) - p.tau_a
    return t.withColumn("assist", F.col("_cand") & F.coalesce(accepted(margin, p), F.lit(False))).drop("_top", "_cand", "_sign")


def keepers(t: DataFrame, p: Params) -> DataFrame:
    """The deepest candidate of each half, if confirmed; the others are rejected without trial."""
    cand = (F.col("n") >= p.tau_n) & ~F.col("assist") & (F.col("q75") >= BOX_X) & (F.abs("my") <= BOX_Y) & (F.signum("mx") != 0)
    t = t.withColumn("_cand", F.coalesce(cand, F.lit(False))).withColumn("_sign", F.signum("mx"))
    first = F.row_number().over(Window.partitionBy("seq", "_sign", "_cand").orderBy(F.abs("mx").desc(), "track_id")) == 1
    return t.withColumn("keeper", F.col("_cand") & first & accepted((F.col("q75") - BOX_X) / 10, p)).drop("_cand", "_sign")


def main_referee(t: DataFrame, p: Params) -> DataFrame:
    """Unclustered, its y range inside the band of the trajectories' means, nearest to the assistants, else to the middle."""
    w = _sequence()
    t = t.withColumn("_hi", p.band * F.max("my").over(w)).withColumn("_lo", p.band * F.min("my").over(w))
    cand = F.col("cluster").isNull() & ~F.col("assist") & ~F.col("keeper") & (F.col("ymax") <= F.col("_hi")) & (F.col("ymin") >= F.col("_lo"))
    t = t.withColumn("_cand", F.coalesce(cand, F.lit(False)))
    # at most two assistants a sequence
    spots = F.collect_list(F.when(F.col("assist"), F.struct("mx", F.coalesce("my", F.lit(0.0)).alias("my")))).over(w)
    dist = F.transform(F.filter("_spots", lambda s: s["mx"].isNotNull()), lambda s: F.hypot(F.col("mx") - s["mx"], F.coalesce("my", F.lit(0.0)) - s["my"]))
    mean = F.aggregate(dist, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(dist), F.lit(0))
    t = t.withColumn("_spots", spots).withColumn("_d", F.when(F.size("_spots") > 0, mean).otherwise(F.abs("my")))
    first = F.row_number().over(Window.partitionBy("seq", "_cand").orderBy(F.col("_d").asc_nulls_last(), "track_id")) == 1
    return t.withColumn("main_referee", F.col("_cand") & first).drop("_hi", "_lo", "_cand", "_spots", "_d")


def cues(t: DataFrame) -> DataFrame:
    """Per sequence, which cluster plays on the left by each cue; null abstains."""
    player = ~F.col("assist") & ~F.col("main_referee") & ~F.col("keeper") & F.col("cluster").isNotNull()
    gk = t.where("keeper").groupBy("seq").agg(F.count("*").alias("n_gk"), F.first("mx").alias("kx"), F.first(F.coalesce("my", F.lit(0.0))).alias("ky"))
    pl = t.where(player).join(gk, "seq", "left")
    dist = F.hypot(F.col("mx") - F.col("kx"), F.coalesce("my", F.lit(0.0)) - F.col("ky"))
    per = pl.groupBy("seq").agg(
        *[F.coalesce(F.sum(F.when(F.col("cluster") == c, F.signum("mx"))), F.lit(0.0)).alias(f"sign{c}") for c in (0, 1)],
        *[F.avg(F.when(F.col("cluster") == c, F.col("mx"))).alias(f"mean{c}") for c in (0, 1)],
        *[F.count(F.when(F.col("cluster") == c, F.col("mx"))).alias(f"n{c}") for c in (0, 1)],
        *[F.percentile(F.when(F.col("cluster") == c, F.col("mx")), F.lit(q)).alias(f"q{int(q * 100)}_{c}") for c in (0, 1) for q in (0.1, 0.9)],
        *[F.avg(F.when((F.col("cluster") == c) & (F.col("n_gk") == 1), dist)).alias(f"dist{c}") for c in (0, 1)],
        F.max(F.when(F.col("n_gk") == 1, F.col("kx"))).alias("kx"),
    )

    def less(a, b):
        return F.when(a < b, 0).when(b < a, 1)

    q = [F.when(F.col(f"n{c}") >= 2, (F.col(f"q10_{c}") + F.col(f"q90_{c}")) / 2) for c in (0, 1)]
    own = less(F.col("dist0"), F.col("dist1"))
    return per.select(
        "seq", F.when(F.abs(F.col("sign0") - F.col("sign1")) >= 1, less(F.col("sign0"), F.col("sign1"))).alias("cue_sign"), less(F.col("mean0"), F.col("mean1")).alias("cue_mean"),
        less(q[0], q[1]).alias("cue_quantile"), F.when(F.col("kx") < 0, own).when(F.col("kx") >= 0, 1 - own).alias("cue_keeper"),
    )


def left_cluster(p: Params) -> Column:
    if p.side_rule == "keeper":
        return F.coalesce("cue_keeper", "cue_quantile", "cue_mean", F.lit(0))
    votes = F.array_compact(F.array("cue_sign", "cue_quantile", "cue_mean"))
    ones, n = F.aggregate(votes, F.lit(0), lambda s, x: s + x), F.size(votes)
    return F.coalesce(F.when(2 * ones < n, 0).when(2 * ones > n, 1).otherwise(F.col("cue_mean")), F.lit(0))


def role_team(t: DataFrame, p: Params = Params()) -> DataFrame:
    """role and team of trajectories (seq, track_id, position statistics, cluster, nearest)."""
    t = main_referee(keepers(assistants(t, p), p), p)
    side = cues(t).select("seq", left_cluster(p).alias("left_cluster"))
    t = t.join(side, "seq", "left").withColumn("left_cluster", F.coalesce("left_cluster", F.lit(0)))
    role = F.when(F.col("assist") | F.col("main_referee"), "referee").when(F.col("keeper"), "goalkeeper").otherwise("player")
    half = F.when(F.col("mx") < 0, "left").otherwise("right")
    cl = F.coalesce("cluster", "nearest")
    team = F.when(role == "goalkeeper", half).when(role == "player", F.when(cl.isNull(), half).when(cl == F.col("left_cluster"), "left").otherwise("right"))
    return t.withColumns({"role": role, "team": team})


def five_class(role: Column, team: Column) -> Column:
    """0 left player, 1 right player, 2 left keeper, 3 right keeper, 4 referee."""
    return F.when(role == "referee", 4).otherwise(F.when(role == "goalkeeper", 2).otherwise(0) + F.when(team == "right", 1).otherwise(0))
