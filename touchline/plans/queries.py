"""Registered queries over the fixture tables, each with DuckDB SQL that must give the same rows.

Float outputs are rounded to six places in both engines: the order in which
doubles are added depends on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators import metric_space, metrics, overlap, roles, tracks, votes
from touchline.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(*cols: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in cols]


D, FR, TR = f"({fx.DETECTIONS})", f"({fx.FRAMES})", f"({fx.TRACKED})"

# --- overlap ---------------------------------------------------------------------------------


def overlap_sql(counts: str) -> str:
    return f"""
WITH d AS MATERIALIZED {D},
p AS (SELECT a.det_id, b.det_id AS o,
        greatest(0.0, least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l)) * greatest(0.0, least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t)) AS i,
        greatest(a.w * a.h, 1e-9) AS ta, greatest(b.w * b.h, 1e-9) AS tb
      FROM d a JOIN d b ON a.image_id = b.image_id AND a.det_id <> b.det_id AND {counts}),
m AS (SELECT det_id, max(i / ta) AS rt, max(i / tb) AS rb FROM p GROUP BY det_id),
x AS (SELECT p.det_id, min(CASE WHEN i / ta = rt THEN o END) AS ot, min(CASE WHEN i / tb = rb THEN o END) AS ob FROM p JOIN m USING (det_id) GROUP BY p.det_id)
SELECT d.det_id, round(coalesce(rt, 0), 6) AS crop_rt, round(coalesce(rb, 0), 6) AS crop_rb, coalesce(rt, 0) <= 0.25 AND coalesce(rb, 0) < 0.40 AS crop_single,
       CASE WHEN rt > 0.25 THEN ot WHEN rb >= 0.40 THEN ob END AS crop_trigger
FROM d LEFT JOIN m USING (det_id) LEFT JOIN x USING (det_id)"""


for _mode, _counts in (("tracked", "b.track_id IS NOT NULL"), ("all", "TRUE"), ("conf", "b.conf > 0.3"), ("tracked_or_conf", "(b.track_id IS NOT NULL OR b.conf > 0.3)")):

    @register(f"x1_crop_filter_{_mode}", overlap_sql(_counts))
    def _(spark, d, mode=_mode):
        return overlap.crop_filter(fx.detections(spark, d), mode).select("det_id", *r6("crop_rt", "crop_rb"), "crop_single", "crop_trigger")


@register(
    "j18_trigger_rows",
    f"WITH f AS ({overlap_sql('b.track_id IS NOT NULL')}) SELECT f.det_id, f.crop_trigger, t.image_id = a.image_id AS same_frame, t.track_id IS NOT NULL AS trigger_tracked FROM f JOIN {D} a ON a.det_id = f.det_id JOIN {D} t ON t.det_id = f.crop_trigger",
)
def _(spark, d):
    f = overlap.crop_filter(fx.detections(spark, d))
    t = fx.detections(spark, d).select(F.col("det_id").alias("t_id"), F.col("image_id").alias("t_image"), F.col("track_id").alias("t_track"))
    return f.join(t, F.col("crop_trigger") == F.col("t_id")).select("det_id", "crop_trigger", (F.col("t_image") == F.col("image_id")).alias("same_frame"), F.col("t_track").isNotNull().alias("trigger_tracked"))


# --- tracks ------------------------------------------------------------------------------------

MEAN = f"SELECT seq, track_id, count(*) AS n_rows, count(CASE WHEN px IS NOT NULL AND py IS NOT NULL THEN 1 END) AS n_positions, avg(CASE WHEN py IS NOT NULL THEN px END) AS mean_x, avg(CASE WHEN px IS NOT NULL THEN py END) AS mean_y FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq, track_id"


@register("a1_mean_position", f"SELECT seq, track_id, n_rows, n_positions, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM ({MEAN}) m")
def _(spark, d):
    return tracks.mean_position(fx.detections(spark, d)).select("seq", "track_id", "n_rows", "n_positions", *r6("mean_x", "mean_y"))


def gate_sql(x: str, y: str, margin: float) -> str:
    return f"""WITH d AS {D}, m AS (SELECT *, abs(mean_x) > 52.5 + {margin} OR abs(mean_y) > 34 + {margin} AS gone FROM
    (SELECT seq, track_id, avg(CASE WHEN py IS NOT NULL THEN {x} END) AS mean_x, avg(CASE WHEN px IS NOT NULL THEN {y} END) AS mean_y FROM d WHERE track_id IS NOT NULL GROUP BY seq, track_id) q)
    SELECT det_id, d.track_id AS track_id_pregate, CASE WHEN NOT coalesce(gone, FALSE) THEN d.track_id END AS track_id, round(mean_x, 9) AS pitch_mean_x, round(mean_y, 9) AS pitch_mean_y, coalesce(gone, FALSE) AS pitch_gate_offpitch
    FROM d LEFT JOIN m ON d.seq = m.seq AND d.track_id = m.track_id"""


@register("a2_pitch_gate", gate_sql("px + 3 * track_id", "py + 2 * track_id", 5.0))
def _(spark, d):
    # shifted by track, so that some tracks lie off the pitch
    det = fx.detections(spark, d).withColumns({"px": F.col("px") + 3 * F.col("track_id"), "py": F.col("py") + 2 * F.col("track_id")})
    # nine places: means over 64 rows end in a 5 at the seventh, which six would round by the order of addition
    return tracks.pitch_gate(det).select("det_id", "track_id_pregate", "track_id", *[F.round(c, 9).alias(c) for c in ("pitch_mean_x", "pitch_mean_y")], "pitch_gate_offpitch")


STATS = f"""SELECT seq, track_id, count(*) AS n, avg(px) AS mx, stddev_pop(px) AS sx, quantile_cont(abs(px), 0.75) AS q75, CASE WHEN count(py) >= 3 THEN avg(py) END AS my,
  CASE WHEN count(py) >= 3 THEN stddev_pop(py) END AS sy, min(py) AS ymin, max(py) AS ymax FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq, track_id"""


@register("a3_position_stats", f"SELECT seq, track_id, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('mx', 'sx', 'q75', 'my', 'sy', 'ymin', 'ymax'))} FROM ({STATS}) s")
def _(spark, d):
    return tracks.position_stats(fx.detections(spark, d)).select("seq", "track_id", "n", *r6("mx", "sx", "q75", "my", "sy", "ymin", "ymax"))


RANKED = f"SELECT *, row_number() OVER (PARTITION BY seq ORDER BY regexp_extract(file_path, '[^/]+$'), image_id) - 1 AS rank FROM {FR} f"


@register("w2_frame_rank", f"SELECT seq, image_id, rank FROM ({RANKED}) r")
def _(spark, d):
    return tracks.frame_rank(fx.frames(spark, d)).select("seq", "image_id", F.col("rank").cast("long").alias("rank"))


for _name, _most in (("w1_carry_forward", 0), ("w1_carry_forward_bounded", 2)):

    @register(
        _name,
        f"""WITH r AS (SELECT *, listed AND score >= 0.5 AS ok FROM ({RANKED}) q), s AS (SELECT *, last_value(CASE WHEN ok THEN rank END IGNORE NULLS) OVER w AS src0, last_value(CASE WHEN ok THEN pan END IGNORE NULLS) OVER w AS p0,
        last_value(CASE WHEN ok THEN tilt END IGNORE NULLS) OVER w AS t0 FROM r WINDOW w AS (PARTITION BY seq ORDER BY rank ROWS UNBOUNDED PRECEDING)), u AS (SELECT *, CASE WHEN {_most} = 0 OR rank - src0 <= {_most} THEN src0 END AS src FROM s)
        SELECT seq, image_id, src AS source_rank, CASE WHEN src IS NOT NULL THEN p0 END AS pan, CASE WHEN src IS NOT NULL THEN t0 END AS tilt, src IS NOT NULL AND NOT ok AS carried FROM u""",
    )
    def _(spark, d, most=_most):
        return tracks.carry_forward(fx.frames(spark, d), 0.5, most).select("seq", "image_id", F.col("source_rank").cast("long").alias("source_rank"), "pan", "tilt", "carried")


@register(
    "w3_stride_samples",
    f"""WITH d AS (SELECT *, bool_or(frame % 5 = 0) OVER (PARTITION BY seq, track_id) AS has FROM {D} q WHERE track_id IS NOT NULL), s AS (SELECT *, row_number() OVER (PARTITION BY seq, track_id ORDER BY frame, det_id) - 1 AS i,
    count(*) OVER (PARTITION BY seq, track_id) AS n FROM d WHERE NOT has OR frame % 5 = 0), k AS (SELECT *, least(16, n) AS k FROM s)
    SELECT det_id, NOT has AS fallback, CASE WHEN k = 1 THEN i = 0 ELSE list_contains(list_transform(range(0, k), lambda j: CAST(floor(j * CAST(n - 1 AS DOUBLE) / (k - 1)) AS BIGINT)), i) END AS is_crop FROM k""",
)
def _(spark, d):
    return tracks.stride_samples(fx.detections(spark, d)).select("det_id", "fallback", "is_crop")


@register("w4_positional_stride", f"SELECT det_id FROM (SELECT det_id, row_number() OVER (PARTITION BY seq, track_id ORDER BY frame, det_id) AS i FROM {D} d WHERE track_id IS NOT NULL) q WHERE (i - 1) % 3 = 0")
def _(spark, d):
    return tracks.positional_stride(fx.detections(spark, d)).select("det_id")


@register(
    "w5_interpolate",
    f"""WITH f AS ({RANKED}), t AS (SELECT t.*, rank, count(*) OVER (PARTITION BY t.seq, track_id) AS n FROM {TR} t JOIN f ON t.seq = f.seq AND t.image_id = f.image_id),
    g AS (SELECT *, lead(rank) OVER w - rank AS dt, lead(l) OVER w AS l2, lead(t) OVER w AS t2, lead(w) OVER w AS w2, lead(h) OVER w AS h2, lead(conf) OVER w AS c2 FROM t WHERE n >= 5 WINDOW w AS (PARTITION BY seq, track_id ORDER BY rank, det_id)),
    x AS (SELECT *, unnest(range(1, dt)) AS j FROM g WHERE dt > 1 AND dt < 25)
    SELECT seq, image_id, track_id, round(l, 6) AS l, round(t, 6) AS t, round(w, 6) AS w, round(h, 6) AS h, round(conf, 6) AS conf, FALSE AS interpolated FROM {TR} o
    UNION ALL SELECT x.seq, f.image_id, track_id, round(l + (l2 - l) * (j / dt), 6), round(t + (t2 - t) * (j / dt), 6), round(w + (w2 - w) * (j / dt), 6), round(h + (h2 - h) * (j / dt), 6), round((conf + c2) / 2, 6), TRUE
    FROM x JOIN f ON f.seq = x.seq AND f.rank = x.rank + j""",
)
def _(spark, d):
    return tracks.interpolate(fx.tracked(spark, d), fx.frames(spark, d)).select("seq", "image_id", "track_id", *r6("l", "t", "w", "h", "conf"), "interpolated")


@register(
    "w6_first_last_clean",
    f"""WITH f AS ({overlap_sql("b.track_id IS NOT NULL")}), d AS (SELECT d.*, crop_single, bool_or(crop_single) OVER (PARTITION BY seq, track_id) AS any_clean FROM {D} d JOIN f USING (det_id) WHERE track_id IS NOT NULL),
    r AS (SELECT seq, track_id, det_id, row_number() OVER (PARTITION BY seq, track_id ORDER BY frame, det_id) AS a, row_number() OVER (PARTITION BY seq, track_id ORDER BY frame DESC, det_id) AS b FROM d WHERE crop_single OR NOT any_clean)
    SELECT seq, track_id, max(CASE WHEN a = 1 THEN det_id END) AS first_det, max(CASE WHEN b = 1 THEN det_id END) AS last_det FROM r GROUP BY seq, track_id""",
)
def _(spark, d):
    return tracks.first_last(overlap.crop_filter(fx.detections(spark, d)))


@register("w10_repeated_in_frame", f"SELECT det_id, count(*) OVER (PARTITION BY image_id, track_id) > 1 AS duplicated FROM {D} d WHERE track_id IS NOT NULL")
def _(spark, d):
    return tracks.repeated_in_frame(fx.detections(spark, d)).select("det_id", "duplicated")


@register("o2_dense_ids", f"SELECT det_id, dense_rank() OVER (PARTITION BY seq ORDER BY track_id) AS new_id FROM {D} d WHERE track_id IS NOT NULL")
def _(spark, d):
    return tracks.dense_ids(fx.detections(spark, d)).select("det_id", F.col("new_id").cast("long").alias("new_id"))


@register("o3_shards", f"SELECT seq, track_id, (row_number() OVER (PARTITION BY seq ORDER BY track_id) - 1) % 3 AS shard FROM (SELECT DISTINCT seq, track_id FROM {D} d WHERE track_id IS NOT NULL) q")
def _(spark, d):
    return tracks.shards(fx.detections(spark, d)).withColumn("shard", F.col("shard").cast("long"))


@register(
    "a8_robust_outliers",
    f"""WITH v AS (SELECT seq, track_id, sqrt(mx * mx + my * my) AS d FROM ({STATS}) s WHERE mx IS NOT NULL AND my IS NOT NULL), m AS (SELECT seq, median(d) AS m FROM v GROUP BY seq),
    s AS (SELECT seq, m, median(abs(d - m)) AS s FROM v JOIN m USING (seq) GROUP BY seq, m) SELECT seq, track_id, round(d, 6) AS d, round(m, 6) AS m, round(s, 6) AS s, s >= 0.05 * m AS enabled, s >= 0.05 * m AND d > m + 1.5 * s AS outlier FROM v JOIN s USING (seq)""",
)
def _(spark, d):
    v = tracks.position_stats(fx.detections(spark, d)).where("mx IS NOT NULL AND my IS NOT NULL").select("seq", "track_id", F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")).alias("d"))
    return tracks.robust_outliers(v, "seq", "d", 1.5).select("seq", "track_id", *r6("d", "m", "s"), "enabled", "outlier")


LONG = "SELECT label, vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings"


@register(
    "a4_median_vectors",
    f"""WITH m AS (SELECT label, pos, median(CAST(v AS DOUBLE)) AS m FROM ({LONG}) q GROUP BY label, pos), n AS (SELECT label, sqrt(sum(m * m)) + 1e-9 AS n FROM m GROUP BY label)
    SELECT label, CAST(pos AS INTEGER) AS pos, round(m / n, 6) AS x FROM m JOIN n USING (label)""",
)
def _(spark, d):
    fx.views(spark, d, "embeddings")
    return tracks.median_vectors(spark.table("embeddings"), ["label"], "embedding").select("label", F.posexplode("unit").alias("pos", "x")).select("label", "pos", *r6("x"))


@register(
    "a6_clean_centroids",
    f"""WITH q AS (SELECT *, vec_id % 3 = 0 AND label <> 4 AS clean FROM ({LONG}) z), k AS (SELECT label, bool_or(clean) AS any_clean FROM q GROUP BY label)
    SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS x FROM q JOIN k USING (label) WHERE clean OR NOT any_clean GROUP BY label, pos""",
)
def _(spark, d):
    fx.views(spark, d, "embeddings")
    rows = spark.table("embeddings").withColumn("clean", (F.col("vec_id") % 3 == 0) & (F.col("label") != 4))
    return tracks.centroids(rows, ["label"], "embedding", "clean").select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", *r6("x"))


@register(
    "j12_nearest_centroid",
    f"""WITH c AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS m FROM ({LONG}) q WHERE vec_id % 2 = 0 GROUP BY label, pos), d AS (SELECT vec_id, c.label AS l, 1 - sum(CAST(v AS DOUBLE) * m) AS d FROM ({LONG}) q JOIN c USING (pos) WHERE vec_id % 2 = 1 GROUP BY vec_id, c.label)
    SELECT vec_id, l AS nearest, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), l) AS r FROM d) z WHERE r = 1""",
)
def _(spark, d):
    fx.views(spark, d, "embeddings")
    rows = spark.table("embeddings").withColumn("t", F.lit(True))
    cents = tracks.centroids(rows.where("vec_id % 2 = 0"), ["label"], "embedding", "t")
    return metric_space.nearest_centre(rows.where("vec_id % 2 = 1"), cents).select("vec_id", "nearest", *r6("distance"))


# --- votes ---------------------------------------------------------------------------------------


def reads(spark: SparkSession, sf_dir: str, reader: str, *more: str) -> DataFrame:
    """Two 11-vectors of log probabilities per tracked box; ``reader`` a or b shifts the hot symbols. more: further columns of the box."""
    d = fx.detections(spark, sf_dir).where("track_id IS NOT NULL")
    a = reader == "a"
    hot = (F.col("track_id") * (3 if a else 5) + F.when(F.col("det_id") % 4 == 0, F.col("det_id")).otherwise(0)) % 11
    unit = (F.col("track_id") * 7 + F.when(F.col("det_id") % (3 if a else 5) == 0, F.col("det_id")).otherwise(0)) % 11
    p = 0.5 + (F.col("det_id") % (37 if a else 41)).cast("double") / 100

    def vec(i):
        return F.array(*[F.when(i == k, F.ln(p)).otherwise(F.ln((1 - p) / 10)) for k in range(11)])

    return d.select("seq", F.concat_ws("_", "seq", F.col("track_id").cast("string")).alias("track"), "det_id", vec(hot).alias("tens"), vec(unit).alias("units"), ((F.col("det_id") * 13 + F.col("image_id") * 7) % 100 / 100).alias("legibility"), (F.col("image_id") % 100 / 100).alias("det_score"), *more)


def reads_sql(reader: str) -> str:
    a = reader == "a"
    return f"""(SELECT concat(seq, '_', CAST(track_id AS STRING)) AS track, det_id, list_transform(range(0, 11), lambda k: CASE WHEN k = hot THEN ln(p) ELSE ln((1 - p) / 10) END) AS tens,
    list_transform(range(0, 11), lambda k: CASE WHEN k = unit THEN ln(p) ELSE ln((1 - p) / 10) END) AS units, (det_id * 13 + image_id * 7) % 100 / 100 AS legibility, image_id % 100 / 100 AS det_score FROM (SELECT *,
    (track_id * {3 if a else 5} + CASE WHEN det_id % 4 = 0 THEN det_id ELSE 0 END) % 11 AS hot, (track_id * 7 + CASE WHEN det_id % {3 if a else 5} = 0 THEN det_id ELSE 0 END) % 11 AS unit,
    0.5 + CAST(det_id % {37 if a else 41} AS DOUBLE) / 100 AS p FROM {D} d WHERE track_id IS NOT NULL) q)"""


def frames_sql(reader: str, where: str = "TRUE") -> str:
    return f"""(SELECT track, det_id, CASE WHEN ti = 10 THEN '-1' WHEN ui = 10 THEN CAST(ti AS STRING) ELSE concat(CAST(ti AS STRING), CAST(ui AS STRING)) END AS label, mt + mu AS raw,
    exp((mt - (mt + ln(list_sum(list_transform(tens, lambda x: exp(x - mt)))))) + (mu - (mu + ln(list_sum(list_transform(units, lambda x: exp(x - mu))))))) AS conf
    FROM (SELECT *, list_max(tens) AS mt, list_max(units) AS mu, list_position(tens, list_max(tens)) - 1 AS ti, list_position(units, list_max(units)) - 1 AS ui FROM {reads_sql(reader)} r WHERE {where}) q)"""


def stats_sql(reader: str, where: str = "TRUE") -> str:
    return f"(SELECT track, label, max(raw) AS mx, sum(conf) AS conf_sum, count(*) AS votes, sum(raw) AS strength, sum(exp(raw)) AS psum FROM {frames_sql(reader, where)} f GROUP BY track, label)"


@register("c1_decode_frames", f"SELECT det_id, label, round(raw, 6) AS raw, round(conf, 6) AS conf FROM {frames_sql('a')} f")
def _(spark, d):
    return votes.decoded(reads(spark, d, "a")).select("det_id", "label", *r6("raw", "conf"))


@register("a12_label_stats", f"SELECT track, label, round(mx, 6) AS mx, round(conf_sum, 6) AS conf_sum, votes, round(strength, 6) AS strength FROM {stats_sql('a')} s")
def _(spark, d):
    return votes.label_stats(votes.decoded(reads(spark, d, "a")), "track").select("track", "label", *r6("mx", "conf_sum"), "votes", *r6("strength"))


POOL = f"(SELECT track, label, max(mx) AS mx, sum(conf_sum) AS conf_sum, sum(votes) AS votes, sum(strength) AS strength FROM (SELECT * FROM {stats_sql('a')} x UNION ALL SELECT * FROM {stats_sql('b')} y) u GROUP BY track, label)"


def both_stats(spark, d):
    return [votes.label_stats(votes.decoded(reads(spark, d, x)), "track") for x in "ab"]


@register("a14_ranked_candidates", f"SELECT track, label, round(mx, 6) AS mx, round(conf_sum, 6) AS conf_sum, CAST(votes AS BIGINT) AS votes, row_number() OVER (PARTITION BY track ORDER BY round(exp(mx) * conf_sum, 9) DESC, votes DESC, round(strength, 9) DESC, label DESC) AS rank FROM {POOL} p")
def _(spark, d):
    a, b = both_stats(spark, d)
    return votes.ranked(votes.pooled(a.unionByName(b), "track"), "track").select("track", "label", *r6("mx", "conf_sum"), "votes", F.col("rank").cast("long").alias("rank"))


@register("a15_vote_pool", f"SELECT track, label, round(votes / CAST(total AS DOUBLE), 6) AS share FROM (SELECT *, sum(votes) OVER (PARTITION BY track) AS total, row_number() OVER (PARTITION BY track ORDER BY votes DESC, round(strength, 9) DESC, label DESC) AS r FROM {POOL} p) q WHERE r = 1")
def _(spark, d):
    return votes.vote_pool(*both_stats(spark, d), "track").select("track", "label", *r6("share"))


RULE_SQL = {
    "vote_pool": "va + vb", "a_mc_x_bcount": "ma * vb", "b_mc_x_acount": "mb * va", "a_mc_x_bcount1": "ma * (1 + vb)", "b_mc_x_acount1": "mb * (1 + va)", "sum": "ma + mb",
    "prod": "ma * mb", "prod_plus1": "(1 + ma) * (1 + mb) - 1", "joint_maxconf": "exp(greatest(amx, bmx)) * (coalesce(acs, 0) + coalesce(bcs, 0))",
}


def fuse_sql() -> str:
    own = {"a_maxconf": ("ma", "va", "ast"), "b_maxconf": ("mb", "vb", "bst")}
    tops = [f"(SELECT track, label AS {n} FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(CAST({s} AS DOUBLE), 9) DESC, va + vb DESC, round(st, 9) DESC, label DESC) AS r FROM j) q WHERE r = 1)" for n, s in RULE_SQL.items()]
    tops += [f"(SELECT track, label AS {n} FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round({s}, 9) DESC, {v} DESC, round({t}, 9) DESC, label DESC) AS r FROM j WHERE {v} > 0) q WHERE r = 1)" for n, (s, v, t) in own.items()]
    return f"""WITH j AS (SELECT coalesce(a.track, b.track) AS track, coalesce(a.label, b.label) AS label, a.mx AS amx, b.mx AS bmx, a.conf_sum AS acs, b.conf_sum AS bcs, coalesce(exp(a.mx) * a.conf_sum, 0) AS ma, coalesce(exp(b.mx) * b.conf_sum, 0) AS mb,
    coalesce(a.votes, 0) AS va, coalesce(b.votes, 0) AS vb, a.strength AS ast, b.strength AS bst, coalesce(a.strength, 0) + coalesce(b.strength, 0) AS st FROM {stats_sql("a")} a FULL JOIN {stats_sql("b")} b ON a.track = b.track AND a.label = b.label)
    SELECT *, CASE WHEN a_maxconf = b_maxconf THEN a_maxconf ELSE joint_maxconf END AS agree_first FROM {tops[0]} t0 {" ".join(f"JOIN {t} t{k + 1} USING (track)" for k, t in enumerate(tops[1:]))}"""


@register("a16_fusion_rules", fuse_sql())
def _(spark, d):
    return votes.fuse(*both_stats(spark, d), "track")


def single_sql() -> str:
    rules = {"vote": "votes", "wvote": "votes * conf_sum", "slogconf": "psum * conf_sum", "maxconf": "exp(mx) * conf_sum"}
    parts = [f"(SELECT track, label AS {n}, round(s / total, 6) AS {n}_share FROM (SELECT *, {e} AS s, sum({e}) OVER (PARTITION BY track) AS total, row_number() OVER (PARTITION BY track ORDER BY round(CAST({e} AS DOUBLE), 9) DESC, votes DESC, round(strength, 9) DESC, label DESC) AS r FROM st) q WHERE r = 1)" for n, e in rules.items()]
    return f"WITH st AS {stats_sql('a')} SELECT *, vote = wvote AS agree_vote_wvote FROM {parts[0]} p0 {' '.join(f'JOIN {p} p{k + 1} USING (track)' for k, p in enumerate(parts[1:]))}"


@register("a17_single_rules", single_sql())
def _(spark, d):
    out = votes.single_rules(votes.label_stats(votes.decoded(reads(spark, d, "a")), "track"), "track")
    return out.withColumns({f"{n}_share": F.round(f"{n}_share", 6) for n in ("vote", "wvote", "slogconf", "maxconf")}).withColumn("agree_vote_wvote", F.col("vote") == F.col("wvote"))


def sum_sql() -> str:
    side = [f"(SELECT track, i AS {c}i, s AS {c}s FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(s, 9) DESC, i) AS r FROM (SELECT track, i, sum(v) AS s FROM (SELECT track, unnest({c}) AS v, unnest(range(0, 11)) AS i FROM r) q GROUP BY track, i) z) y WHERE r = 1)" for c in ("tens", "units")]
    return f"""WITH r AS {reads_sql("a")}, n AS (SELECT track, count(*) AS n FROM r GROUP BY track) SELECT track, CASE WHEN tensi = 10 THEN '-1' WHEN unitsi = 10 THEN CAST(tensi AS STRING) ELSE concat(CAST(tensi AS STRING), CAST(unitsi AS STRING)) END AS sum,
    round(CASE WHEN tensi <> 10 THEN CASE WHEN unitsi <> 10 THEN (tenss + unitss) / 2 ELSE tenss END / n END, 6) AS sum_conf FROM {side[0]} a JOIN {side[1]} b USING (track) JOIN n USING (track)"""


@register("a17_position_sums", sum_sql())
def _(spark, d):
    return votes.position_sums(reads(spark, d, "a"), "track").select("track", "sum", *r6("sum_conf"))


@register("x13_gated_vote", f"SELECT track, label, round(votes / CAST(total AS DOUBLE), 6) AS share FROM (SELECT *, sum(votes) OVER (PARTITION BY track) AS total, row_number() OVER (PARTITION BY track ORDER BY votes DESC, round(strength, 9) DESC, label DESC) AS r FROM (SELECT track, label, sum(votes) AS votes, sum(strength) AS strength FROM (SELECT * FROM {stats_sql('a', 'legibility > 0.5 AND det_score > 0.52')} x UNION ALL SELECT * FROM {stats_sql('b', 'legibility > 0.5 AND det_score > 0.52')} y) u GROUP BY track, label) p) q WHERE r = 1")
def _(spark, d):
    a, b = (votes.label_stats(votes.decoded(votes.gated(reads(spark, d, x))), "track") for x in "ab")
    return votes.vote_pool(a, b, "track").select("track", "label", *r6("share"))


@register("p13_keep_never_empty", f"WITH d AS (SELECT det_id, image_id, conf, bool_or(conf < 0.2) OVER w AS s, min(conf) OVER w AS m FROM {D} d WINDOW w AS (PARTITION BY image_id)) SELECT det_id, NOT s AS kept_by_minimum FROM d WHERE CASE WHEN s THEN conf < 0.2 ELSE conf = m END")
def _(spark, d):
    return votes.keep_some(fx.detections(spark, d), "image_id", "conf", 0.2).select("det_id", "kept_by_minimum")


# --- roles -----------------------------------------------------------------------------------------


def trajectories(spark, d):
    t = tracks.position_stats(fx.detections(spark, d))
    near = (F.col("track_id") % 2).cast("int")
    return t.withColumns({"my": F.col("my") * 1.5 + F.col("track_id") - 12, "mx": F.col("mx") + 6 * (F.col("track_id") - 12), "q75": F.col("q75") + F.col("track_id") - 10, "sy": F.col("sy") / 10}).withColumns({"nearest": near, "cluster": F.when(F.col("track_id") % 6 > 0, near)})


TRAJ = f"(SELECT seq, track_id, n, mx + 6 * (track_id - 12) AS mx, sx, q75 + track_id - 10 AS q75, my * 1.5 + track_id - 12 AS my, sy / 10 AS sy, ymin, ymax, CAST(track_id % 2 AS INTEGER) AS nearest, CASE WHEN track_id % 6 > 0 THEN CAST(track_id % 2 AS INTEGER) END AS cluster FROM ({STATS}) s)"

ROLE_SQL = f"""WITH t AS {TRAJ},
a AS (SELECT *, max(abs(my)) OVER (PARTITION BY seq) AS top FROM t), b AS (SELECT *, coalesce(n >= 5 AND abs(my) >= 0.85 * top AND sy <= 3, FALSE) AS c FROM a),
c AS (SELECT *, c AND (sign(my) = 0 OR row_number() OVER (PARTITION BY seq, sign(my), c ORDER BY abs(my) DESC, track_id) = 1) AS c2 FROM b),
e AS (SELECT *, c2 AND coalesce(cluster IS NULL OR abs(my) / (top + 1e-9) - 0.85 >= 0.3, FALSE) AS assist FROM c),
g AS (SELECT *, coalesce(n >= 5 AND NOT assist AND q75 >= 36 AND abs(my) <= 20.16 AND sign(mx) <> 0, FALSE) AS k FROM e),
h AS (SELECT *, k AND row_number() OVER (PARTITION BY seq, sign(mx), k ORDER BY abs(mx) DESC, track_id) = 1 AND (cluster IS NULL OR (q75 - 36) / 10 >= 0.3) AS keeper FROM g),
i AS (SELECT *, coalesce(cluster IS NULL AND NOT assist AND NOT keeper AND ymax <= 0.9 * max(my) OVER s AND ymin >= 0.9 * min(my) OVER s, FALSE) AS m FROM h WINDOW s AS (PARTITION BY seq)),
sp AS (SELECT i.seq, i.track_id, avg(sqrt((i.mx - x.mx) * (i.mx - x.mx) + (coalesce(i.my, 0) - coalesce(x.my, 0)) * (coalesce(i.my, 0) - coalesce(x.my, 0)))) AS da FROM i JOIN i x ON i.seq = x.seq AND x.assist GROUP BY i.seq, i.track_id),
j AS (SELECT i.*, m AND row_number() OVER (PARTITION BY i.seq, m ORDER BY coalesce(da, abs(my)) NULLS LAST, i.track_id) = 1 AS ref FROM i LEFT JOIN sp ON sp.seq = i.seq AND sp.track_id = i.track_id),
gk AS (SELECT seq, count(*) AS ng, any_value(mx) AS kx, any_value(coalesce(my, 0)) AS ky FROM j WHERE keeper GROUP BY seq),
p AS (SELECT j.*, CASE WHEN ng = 1 THEN sqrt((mx - kx) * (mx - kx) + (coalesce(my, 0) - ky) * (coalesce(my, 0) - ky)) END AS d, CASE WHEN ng = 1 THEN kx END AS k1 FROM j LEFT JOIN gk USING (seq) WHERE NOT assist AND NOT ref AND NOT keeper AND cluster IS NOT NULL),
q AS (SELECT seq, max(k1) AS kx, avg(d) FILTER (cluster = 0) AS d0, avg(d) FILTER (cluster = 1) AS d1, avg(mx) FILTER (cluster = 0) AS m0, avg(mx) FILTER (cluster = 1) AS m1,
  CASE WHEN count(mx) FILTER (cluster = 0) >= 2 THEN (quantile_cont(mx, 0.1) FILTER (cluster = 0) + quantile_cont(mx, 0.9) FILTER (cluster = 0)) / 2 END AS q0,
  CASE WHEN count(mx) FILTER (cluster = 1) >= 2 THEN (quantile_cont(mx, 0.1) FILTER (cluster = 1) + quantile_cont(mx, 0.9) FILTER (cluster = 1)) / 2 END AS q1 FROM p GROUP BY seq),
o AS (SELECT seq, CASE WHEN d0 < d1 THEN CASE WHEN kx < 0 THEN 0 ELSE 1 END WHEN d1 < d0 THEN CASE WHEN kx < 0 THEN 1 ELSE 0 END WHEN q0 < q1 THEN 0 WHEN q1 < q0 THEN 1 WHEN m0 < m1 THEN 0 WHEN m1 < m0 THEN 1 ELSE 0 END AS lft FROM q),
r AS (SELECT j.*, coalesce(lft, 0) AS lft, CASE WHEN assist OR ref THEN 'referee' WHEN keeper THEN 'goalkeeper' ELSE 'player' END AS role FROM j LEFT JOIN o USING (seq))
SELECT seq, track_id, role, CASE WHEN role = 'goalkeeper' THEN CASE WHEN mx < 0 THEN 'left' ELSE 'right' END WHEN role = 'player' THEN CASE WHEN coalesce(cluster, nearest) = lft THEN 'left' ELSE 'right' END END AS team FROM r"""


@register("x8_role_team", ROLE_SQL)
def _(spark, d):
    return roles.role_team(trajectories(spark, d)).select("seq", "track_id", "role", "team")


@register("x16_five_class", f"SELECT seq, track_id, CASE WHEN role = 'referee' THEN 4 ELSE CASE WHEN role = 'goalkeeper' THEN 2 ELSE 0 END + CASE WHEN team = 'right' THEN 1 ELSE 0 END END AS class FROM ({ROLE_SQL}) z")
def _(spark, d):
    return roles.role_team(trajectories(spark, d)).select("seq", "track_id", roles.five_class(F.col("role"), F.col("team")).alias("class"))


# --- metrics ------------------------------------------------------------------------------------------

GT_SQL = "(SELECT CAST(doc_id AS STRING) AS track, CASE WHEN quality = 1 THEN CAST(doc_id % 30 AS STRING) ELSE '-1' END AS gt FROM labels)"
PRED_SQL = "(SELECT CAST(doc_id AS STRING) AS track, CASE WHEN toxic = 0 THEN CAST(doc_id % 29 AS STRING) ELSE '-1' END AS pred FROM labels WHERE doc_id % 7 > 0)"


def gt_pred(spark, d):
    fx.views(spark, d, "labels")
    return spark.sql(f"SELECT * FROM {GT_SQL}"), spark.sql(f"SELECT * FROM {PRED_SQL}")


GP = f"(SELECT g.track, gt, coalesce(pred, '-1') AS pred FROM {GT_SQL} g LEFT JOIN {PRED_SQL} p USING (track))"


@register("a21_track_accuracy", f"SELECT round(avg(CASE WHEN pred = gt THEN 1.0 ELSE 0 END), 6) AS acc_all, round(avg(CASE WHEN gt <> '-1' THEN CASE WHEN pred = gt THEN 1.0 ELSE 0 END END), 6) AS acc_numbered, count(*) AS n FROM {GP} j")
def _(spark, d):
    return metrics.track_accuracy(*gt_pred(spark, d)).select(*r6("acc_all", "acc_numbered"), "n")


@register("a22_minus_one", f"SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS p, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS r FROM (SELECT count(*) FILTER (gt = '-1' AND pred = '-1') AS tp, count(*) FILTER (gt <> '-1' AND pred = '-1') AS fp, count(*) FILTER (gt = '-1' AND pred <> '-1') AS fn FROM {GP} j) q) z")
def _(spark, d):
    return metrics.minus_one(*gt_pred(spark, d)).select("tp", "fp", "fn", *r6("precision", "recall", "f1"))


@register("a23_by_digits", f"SELECT length(gt) AS digits, count(*) AS n, round(avg(CASE WHEN pred = gt THEN 1.0 ELSE 0 END), 6) AS acc FROM {GP} j WHERE gt <> '-1' GROUP BY length(gt)")
def _(spark, d):
    return metrics.by_digits(*gt_pred(spark, d)).select(F.col("digits").cast("long").alias("digits"), "n", *r6("acc"))


@register("a24_image_metrics", "SELECT round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(1 - levenshtein(a, b) / CAST(greatest(length(a), length(b), 1) AS DOUBLE)), 6) AS one_minus_ned, count(*) AS n_images FROM (SELECT c_name AS a, concat('Customer#', CAST(c_custkey % 700 AS STRING)) AS b FROM customer) q")
def _(spark, d):
    fx.views(spark, d, "customer")
    return metrics.image_metrics(spark.table("customer").select(F.col("c_name").alias("pred"), F.concat(F.lit("Customer#"), (F.col("c_custkey") % 700).cast("string")).alias("gt"))).select(*r6("accuracy", "one_minus_ned"), "n_images")


IOU_SQL = f"(SELECT *, CASE WHEN u > 0 THEN i / u ELSE 0 END AS iou FROM (SELECT a.seq, a.image_id, a.det_id AS pred_id, b.det_id AS gt_id, a.w * a.h + b.w * b.h - greatest(0.0, least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l)) * greatest(0.0, least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t)) AS u, greatest(0.0, least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l)) * greatest(0.0, least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t)) AS i FROM (SELECT * FROM {D} d WHERE conf > 0.2) a JOIN (SELECT det_id, image_id, l + 3 AS l, t + 2 AS t, w, h FROM {D} d) b ON a.image_id = b.image_id) q)"


def pred_gt(spark, d):
    det = fx.detections(spark, d)
    return det.where("conf > 0.2"), det.withColumns({"l": F.col("l") + 3, "t": F.col("t") + 2})


@register("j16_iou_pairs", f"SELECT pred_id, gt_id, round(iou, 6) AS iou FROM {IOU_SQL} z WHERE iou > 0")
def _(spark, d):
    return metrics.iou_pairs(*pred_gt(spark, d)).select("pred_id", "gt_id", *r6("iou"))


@register("a33_best_attempt", f"WITH q AS (SELECT seq, image_id % 4 AS attempt, coalesce(avg(score) FILTER (score >= 0.4), 0) AS mean, count(*) FILTER (score >= 0.4) AS accepted, count(*) AS frames FROM {FR} f GROUP BY seq, image_id % 4) SELECT seq, attempt, round(mean, 6) AS mean, accepted, frames, row_number() OVER (PARTITION BY seq ORDER BY round(mean, 9) DESC, accepted DESC, attempt) = 1 AS winner FROM q")
def _(spark, d):
    return metrics.best_attempt(fx.frames(spark, d).withColumn("attempt", F.col("image_id") % 4), 0.4).select("seq", "attempt", *r6("mean"), "accepted", "frames", "winner")


# --- text functions -----------------------------------------------------------------------------------


@register("c6_norm_jn", f"SELECT det_id, CASE WHEN regexp_full_match(regexp_replace(trim(v), '\\.0$', ''), '[0-9]+') THEN CAST(regexp_replace(trim(v), '\\.0$', '') AS INTEGER) ELSE -1 END AS jn FROM (SELECT det_id, CASE det_id % 4 WHEN 0 THEN concat(number, '.0') WHEN 1 THEN concat(' ', number) WHEN 2 THEN concat('x', number) ELSE number END AS v FROM {D} d) q")
def _(spark, d):
    k, n = F.col("det_id") % 4, F.col("number")
    v = F.when(k == 0, F.concat(n, F.lit(".0"))).when(k == 1, F.concat(F.lit(" "), n)).when(k == 2, F.concat(F.lit("x"), n)).otherwise(n)
    return fx.detections(spark, d).select("det_id", F.coalesce(text.norm_jn(v), F.lit(-1)).alias("jn"))


@register("c13_paths", f"SELECT image_id, regexp_extract(file_path, '[^/]+$') AS name, regexp_replace(regexp_extract(file_path, '[^/]+$'), '\\.[^.]*$', '') AS stem, string_split(file_path, '/')[-3] AS grandparent FROM {FR} f")
def _(spark, d):
    p = F.col("file_path")
    return fx.frames(spark, d).select("image_id", text.basename(p).alias("name"), text.stem(p).alias("stem"), text.grandparent(p).alias("grandparent"))


@register("s12_fingerprint", f"SELECT det_id, left(sha256(concat_ws('|', seq, CAST(image_id AS STRING), number)), 16) AS fp, CAST(CASE WHEN number IS NOT NULL AND regexp_full_match(number, '[1-9][0-9]?') THEN TRUE ELSE FALSE END AS BOOLEAN) AS valid FROM {D} d")
def _(spark, d):
    return fx.detections(spark, d).select("det_id", text.fingerprint(F.col("seq"), F.col("image_id").cast("string"), F.col("number")).alias("fp"), text.shirt(F.col("number")).alias("valid"))


# --- the flagship: overlap label, off-pitch gate, track summary ------------------------------------------


@register(
    "flagship_track_summary",
    f"""WITH f AS ({overlap_sql("b.track_id IS NOT NULL")}), g AS ({gate_sql("px", "py", 5.0)})
    SELECT d.seq, g.track_id, count(*) AS n, round(avg(CASE WHEN crop_single THEN 1.0 ELSE 0 END), 6) AS share_single, round(max(pitch_mean_x), 6) AS mean_x FROM {D} d JOIN f USING (det_id) JOIN g USING (det_id) WHERE g.track_id IS NOT NULL GROUP BY d.seq, g.track_id""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = tracks.pitch_gate(overlap.crop_filter(fx.detections(spark, sf_dir)))
    return det.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("crop_single").cast("double")), 6).alias("share_single"), F.round(F.max("pitch_mean_x"), 6).alias("mean_x"))
