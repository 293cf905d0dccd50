"""Data-quality checks. Each is one aggregate that returns (seq, component, verdict, note, observed); a union of them is the audit.

Verdicts are ordered INFO < PASS < WARN < FAIL and the worst one counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators import tracks

ORDER = ("INFO", "PASS", "WARN", "FAIL")


def verdict(*rules: tuple[Column, str, str]) -> tuple[Column, Column]:
    """Worst verdict and joined notes of (condition, verdict, note) rules; PASS where none holds."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(ORDER.index(v)).alias("o"), F.lit(n).alias("n"))) for c, v, n in rules]))
    worst = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(hit, lambda x: x["o"])), F.lit(1)))
    return F.get(F.array(*[F.lit(v) for v in ORDER]), worst), F.array_join(F.transform(hit, lambda x: x["n"]), "; ")


def finding(per: DataFrame, component: str, observed: dict[str, Column], *rules: tuple[Column, str, str]) -> DataFrame:
    v, n = verdict(*rules)
    seen = F.create_map(*[x for k, c in observed.items() for x in (F.lit(k), c.cast("double"))])
    return per.select("seq", F.lit(component).alias("component"), v.alias("verdict"), n.alias("note"), seen.alias("observed"))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def audit(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def run_gate(findings: DataFrame) -> DataFrame:
    """Whether any check warned or failed."""
    return findings.agg(F.bool_or(F.col("verdict") == "WARN").alias("warned"), F.bool_or(F.col("verdict") == "FAIL").alias("failed"))


def run_integrity(findings: DataFrame, log: DataFrame, artifacts: DataFrame, required: dict[str, int], patterns: tuple | None = None) -> DataFrame:
    """One row for a run: failed, its problems and its notes, each in order.

    A check that failed, a line of the log (value) with a pattern of failure, an
    artifact of a required kind that is missing, empty or unreadable, and a kind that covers fewer
    sequences than required are problems; warnings are notes. artifacts: kind, seq, entries (null: unreadable).
    """
    checks = findings.where("verdict IN ('FAIL', 'WARN')").select(F.col("verdict").alias("v"), F.concat(F.lit("check "), "seq", F.lit(": "), "component").alias("t"))
    lines = log_failures(log, patterns or FAILURES).select(F.lit("FAIL").alias("v"), F.format_string("log: %s (%d)", "pattern", "n").alias("t"))
    empty = artifacts.where("coalesce(entries, 0) = 0").select(F.lit("FAIL").alias("v"), F.concat("kind", F.lit(" "), "seq", F.when(F.col("entries").isNull(), ": unreadable").otherwise(": empty")).alias("t"))
    kinds = F.explode(F.create_map(*[F.lit(x) for k, n in sorted(required.items()) for x in (k, n)])).alias("kind", "want")
    have = artifacts.groupBy("kind").agg(F.count_distinct("seq").alias("n"))
    short = findings.sparkSession.range(1).select(kinds).join(have, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < want").select(F.lit("FAIL").alias("v"), F.format_string("%s covers %d of %d sequences", "kind", "n", "want").alias("t"))
    told = audit(checks, lines, empty, short)
    pick = lambda v: F.array_sort(F.collect_list(F.when(F.col("v") == v, F.col("t"))))
    return told.agg(F.coalesce(F.bool_or(F.col("v") == "FAIL"), F.lit(False)).alias("failed"), pick("FAIL").alias("problems"), pick("WARN").alias("notes"))


def detector(det: DataFrame, frames: DataFrame, least: float = 0.98) -> DataFrame:
    """Frames with a detection."""
    have = det.select("seq", "image_id").distinct().withColumn("hit", F.lit(1))
    per = frames.select("seq", "image_id").distinct().join(have, ["seq", "image_id"], "left").groupBy("seq").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    s = share(F.col("k"), F.col("n"))
    return finding(per, "bbox_detector", {"share": s, "frames": F.col("n")}, (F.col("k") == 0, "FAIL", "no detections"), (s < least, "WARN", "frames without detections"))


def tracked_share(det: DataFrame, least: float = 0.5) -> DataFrame:
    per = det.groupBy("seq").agg(F.count("track_id").alias("k"), F.count("*").alias("n"))
    s = share(F.col("k"), F.col("n"))
    return finding(per, "track", {"share": s}, (F.col("k") == 0, "FAIL", "nothing is tracked"), (s < least, "WARN", "few detections are tracked"))


def track_lengths(det: DataFrame, least: int = 3) -> DataFrame:
    n = det.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.count("*").alias("n"))
    per = n.groupBy("seq").agg(F.median("n").alias("m"), F.min("n").alias("s"), F.count("*").alias("t"))
    return finding(per, "track_lengths", {"median": F.col("m"), "min": F.col("s"), "tracks": F.col("t")}, (F.col("m") < least, "WARN", "short tracks"))


def tracker_internals(sidecar: DataFrame, frames: DataFrame, zero_warn: float = 0.01, clipped_warn: float = 0.001) -> DataFrame:
    """sidecar: seq, image_id, ran, identity (warp is the identity), clipped. Coverage, and shares without the first frame.

    With n_high (confident boxes), zero_emb (of them with a zero embedding) and n_clipped a frame, also the shares of those.
    """
    more = {"n_high", "zero_emb", "n_clipped"} <= set(sidecar.columns)
    first = F.min("image_id").over(Window.partitionBy("seq"))
    sums = [F.sum(c).alias(c) for c in ("n_high", "zero_emb", "n_clipped")] if more else []
    s = sidecar.withColumn("first", first == F.col("image_id")).groupBy("seq").agg(F.count("*").alias("k"), F.count_if(~F.col("ran")).alias("idle"), F.count_if(F.col("identity") & ~F.col("first")).alias("ident"), F.count_if(F.col("clipped")).alias("clip"), *sums)
    per = frames.groupBy("seq").agg(F.count("*").alias("n")).join(s, "seq", "left")
    cover, ident = share(F.coalesce("k", F.lit(0)), F.col("n")), share(F.col("ident"), F.greatest(F.col("k") - 1, F.lit(1)))
    seen = {"coverage": cover, "identity": ident, "clipped": share(F.col("clip"), F.col("k"))}
    rules = [(cover < 1, "FAIL", "frames without tracker record"), (F.col("idle") > 0, "FAIL", "declared but not run"), (ident > 0.5, "WARN", "camera motion is mostly the identity")]
    if more:
        zero, cut = share(F.col("zero_emb"), F.col("n_high")), share(F.col("n_clipped"), F.col("n_high"))
        seen |= {"zero": zero, "clipped_crops": cut}
        rules += [((F.col("n_high") > 0) & (F.col("zero_emb") == F.col("n_high")), "FAIL", "no confident box has an embedding"), (zero > zero_warn, "WARN", "many zero embeddings"), (cut > clipped_warn, "WARN", "many clipped crops")]
    return finding(per, "tracker", seen, *rules)


def crop_labels(det: DataFrame, thr_target: float = 0.25, thr_other: float = 0.40) -> DataFrame:
    """Labels agree with the stored ratios, and every contaminated box names a box of its frame."""
    t = det.select(F.col("det_id").alias("_t"), F.col("image_id").alias("_ti"))
    j = det.join(t, F.col("crop_trigger") == F.col("_t"), "left")
    expect = (F.col("crop_rt") <= thr_target) & (F.col("crop_rb") < thr_other)
    per = j.groupBy("seq").agg(
        F.count_if(F.col("crop_single").isNull()).alias("missing"), F.count_if(F.col("crop_single") != expect).alias("wrong"),
        F.count_if(~F.col("crop_single") & F.col("crop_trigger").isNull()).alias("silent"), F.count_if(F.col("crop_trigger").isNotNull() & ~F.coalesce(F.col("_ti") == F.col("image_id"), F.lit(False))).alias("foreign"),
        F.count_if(F.col("crop_single") & F.col("crop_trigger").isNotNull()).alias("extra"),
    )
    return finding(per, "crop_filter", {c: F.col(c) for c in ("missing", "wrong", "silent", "foreign", "extra")}, (F.col("missing") > 0, "FAIL", "unlabelled boxes"), (F.col("wrong") > 0, "FAIL", "label contradicts the ratios"), (F.col("silent") + F.col("foreign") + F.col("extra") > 0, "FAIL", "bad triggers"))


def calibration(frames: DataFrame, least: float = 0.9) -> DataFrame:
    """frames with source_rank (null: lost) and carried."""
    per = frames.groupBy("seq").agg(F.count("*").alias("n"), F.count("source_rank").alias("k"), F.count_if("carried").alias("c"))
    s = share(F.col("k"), F.col("n"))
    return finding(per, "calibration", {"coverage": s, "carried": share(F.col("c"), F.col("n"))}, (F.col("k") == 0, "FAIL", "no camera"), (s < least, "WARN", "frames without camera"))


def pitch_gate(det: DataFrame, margin: float, enabled: bool = True) -> DataFrame:
    """Means and flags equal those made anew from the incoming ids; ids are cleared exactly where flagged, or nowhere if disabled."""
    again = tracks.mean_position(det.withColumn("track_id", F.col("track_id_pregate")), tracks.mean).withColumn("off", tracks.off_pitch(margin)).select(F.col("seq").alias("_s"), F.col("track_id").alias("_t"), F.col("mean_x").alias("_x"), F.col("mean_y").alias("_y"), "off")
    j = det.join(again, (F.col("seq") == F.col("_s")) & (F.col("track_id_pregate") == F.col("_t")), "left")
    apart = F.coalesce(F.abs(F.col("pitch_mean_x") - F.col("_x")) > 1e-6, F.lit(False)) | F.coalesce(F.abs(F.col("pitch_mean_y") - F.col("_y")) > 1e-6, F.lit(False)) | (F.col("pitch_mean_x").isNull() != F.col("_x").isNull())
    want = F.when(F.col("pitch_gate_offpitch") & F.lit(enabled), F.lit(None)).otherwise(F.col("track_id_pregate"))
    per = j.groupBy("seq").agg(F.count_if(apart).alias("means"), F.count_if(F.col("pitch_gate_offpitch") != F.coalesce("off", F.lit(False))).alias("flags"), F.count_if(~F.col("track_id").eqNullSafe(want)).alias("ids"))
    return finding(per, "pitch_gate", {c: F.col(c) for c in ("means", "flags", "ids")}, (F.col("means") > 0, "FAIL", "means differ"), (F.col("flags") > 0, "FAIL", "flags differ"), (F.col("ids") > 0, "FAIL", "ids changed otherwise than flagged"))


def split(det: DataFrame) -> DataFrame:
    """Every fragment has one incoming track, and tracks keep their rows."""
    frag = det.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.count_distinct("track_id_presplit").alias("o"))
    per = frag.groupBy("seq").agg(F.count_if(F.col("o") > 1).alias("merged"), F.count("*").alias("fragments"))
    lost = det.groupBy("seq").agg(F.count_if(F.col("track_id").isNull() != F.col("track_id_presplit").isNull()).alias("lost"))
    return finding(per.join(lost, "seq"), "tracklet_split", {"merged": F.col("merged"), "fragments": F.col("fragments"), "lost": F.col("lost")}, (F.col("merged") > 0, "FAIL", "a fragment joins tracks"), (F.col("lost") > 0, "FAIL", "rows changed sides"))


def team_embed(tracks_: DataFrame) -> DataFrame:
    """tracks: seq, track_id, n_single, cluster, nearest."""
    per = tracks_.groupBy("seq").agg(F.count("*").alias("n"), F.count("nearest").alias("k"), F.count_if((F.col("n_single") > 0) & F.col("nearest").isNull()).alias("gone"), F.count_if(~F.coalesce("cluster", F.lit(0)).isin(0, 1)).alias("odd"), F.count_if(F.col("cluster").isNotNull() & F.col("nearest").isNull()).alias("half"))
    return finding(per, "team_embed", {c: F.col(c) for c in ("n", "k", "gone", "odd", "half")}, (F.col("odd") > 0, "FAIL", "clusters other than 0 and 1"), (F.col("half") > 0, "FAIL", "cluster without nearest"), (F.col("gone") > 0, "WARN", "tracks with clean crops lack an embedding"))


def role_team(t: DataFrame, most_referees: int = 3, most_keepers: int = 2) -> DataFrame:
    """t: seq, track_id, role, team per row or trajectory."""
    one = t.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.count_distinct("role").alias("r"), F.count_distinct("team").alias("s"), F.max("role").alias("role"), F.max("team").alias("team"))
    known = F.coalesce(F.col("role").isin("player", "goalkeeper", "referee"), F.lit(False))
    sided = F.when(F.col("role") == "referee", F.col("team").isNull()).otherwise(F.coalesce(F.col("team").isin("left", "right"), F.lit(False)))
    per = one.groupBy("seq").agg(F.count_if(~known).alias("roles"), F.count_if(~sided).alias("sides"), F.count_if((F.col("r") > 1) | (F.col("s") > 1)).alias("mixed"), F.count_if(F.col("role") == "referee").alias("refs"), F.count_if(F.col("role") == "goalkeeper").alias("keepers"))
    return finding(per, "role_team", {c: F.col(c) for c in ("roles", "sides", "mixed", "refs", "keepers")}, (F.col("roles") > 0, "FAIL", "unknown roles"), (F.col("sides") > 0, "FAIL", "team does not fit the role"), (F.col("mixed") > 0, "FAIL", "not constant on a track"), (F.col("refs") > most_referees, "WARN", "many referees"), (F.col("keepers") > most_keepers, "WARN", "many goalkeepers"))


def jersey(eligible: DataFrame, answers: DataFrame) -> DataFrame:
    """Tracks that may have a number (seq, track_id) without an answer, and answers nobody asked for."""
    missing = eligible.join(answers.select("seq", "track_id"), ["seq", "track_id"], "left_anti").groupBy("seq").agg(F.count("*").alias("missing"))
    extra = answers.join(eligible.select("seq", "track_id"), ["seq", "track_id"], "left_anti").groupBy("seq").agg(F.count("*").alias("extra"))
    per = eligible.groupBy("seq").agg(F.count("*").alias("n")).join(missing, "seq", "left").join(extra, "seq", "left").na.fill(0, ["missing", "extra"])
    return finding(per, "jersey_number_detect", {c: F.col(c) for c in ("n", "missing", "extra")}, (F.col("missing") > 0, "FAIL", "eligible tracks without an answer"), (F.col("extra") > 0, "WARN", "answers without an eligible track"))


def jersey_cache(rows: DataFrame, blobs: DataFrame, results: DataFrame, digests: dict[str, str], rule: str, single_only: bool = True) -> DataFrame:
    """The number column against the cached answers it was made from.

    rows: seq, track_id, crop_single, number of tracked boxes. blobs: a row per
    sequence with rule, single_crops_only, manifest_tracklets, manifest_frames and the digests of the files that answered, under the names in ``digests``, which has
    the digests of the files as they are. results: seq, track_id, number, n_used of cached answers.
    """
    per = rows.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(
        F.count_distinct("number").alias("kinds"), F.max(F.expr("cast(try_cast(number AS int) AS string)")).alias("shown"), F.bool_or("crop_single").alias("single"), F.count_if("crop_single").alias("crops")
    )
    eligible = F.coalesce("single", F.lit(False)) if single_only else F.lit(True)
    said = results.select("seq", "track_id", F.when(F.col("number").rlike("^[0-9]+$"), F.expr("cast(cast(number AS int) AS string)")).alias("said"), F.lit(True).alias("answered"))
    j = per.withColumn("eligible", eligible).join(said, ["seq", "track_id"], "left")
    n = j.groupBy("seq").agg(
        F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("answered").isNull()).alias("missing"), F.count_if(F.col("kinds") > 1).alias("mixed"),
        F.count_if(F.col("answered").isNotNull() & ~F.col("shown").eqNullSafe(F.col("said"))).alias("disagree"), F.count_if(~F.col("eligible") & F.col("shown").isNotNull()).alias("unasked"),
        F.sum(F.when(F.col("eligible"), F.col("crops")).otherwise(0)).alias("crops"),
    )
    p = n.join(blobs.withColumn("blob", F.lit(True)), "seq", "left")
    no = F.lit(False)
    fake = sum([F.coalesce(~F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(True)).cast("int") for c in digests], F.lit(0))
    other = sum([F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$") & (F.col(c) != v), no).cast("int") for c, v in digests.items()], F.lit(0))
    seen = {c: F.col(c) for c in ("eligible", "missing", "mixed", "disagree", "unasked")} | {"no_digest": F.when(F.col("blob"), fake), "other_digest": F.when(F.col("blob"), other)}
    there = F.coalesce("blob", no)
    return finding(
        p, "jersey_cache", seen, (~there, "FAIL", "no cached answers"), (there & ~F.col("rule").eqNullSafe(F.lit(rule)), "FAIL", "answered by another rule"),
        (there & ~F.col("single_crops_only").eqNullSafe(F.lit(single_only)), "FAIL", "asked about other crops"), (there & (F.col("manifest_tracklets") != F.col("eligible")), "FAIL", "asked about other tracks"),
        (there & single_only & (F.col("manifest_frames") != F.col("crops")), "FAIL", "asked about another number of crops"), (there & (fake > 0), "FAIL", "no real digest"), (there & (other > 0), "FAIL", "answered by other files"),
        (there & (F.col("missing") > 0), "FAIL", "eligible tracks without an answer"), (F.col("mixed") > 0, "FAIL", "numbers differ on a track"), (there & (F.col("disagree") > 0), "FAIL", "column differs from the answers"),
        (F.col("unasked") > 0, "FAIL" if single_only else "WARN", "numbers on tracks that were not asked about"),
    )


def role_reasons(per: DataFrame, level: DataFrame, tracks_: DataFrame) -> DataFrame:
    """per: seq, track_id, why of each trajectory; level: seq, n_fallback_nearest, n_fallback_half as the stage counted; tracks_: seq, track_id of the rows."""
    own = per.groupBy("seq").agg(F.count("*").alias("told"), F.count_if(F.col("why") == "player_nearest_centroid").alias("near"), F.count_if(F.col("why") == "player_half_fallback").alias("half"), F.count_if(F.col("why") == "assistant").alias("assistants"), F.count_if(F.col("why") == "main_2.14").alias("main"))
    n = tracks_.where("track_id IS NOT NULL").groupBy("seq").agg(F.count_distinct("track_id").alias("n"))
    p = n.join(own, "seq", "left").join(level, "seq", "left").na.fill(0)
    off = (F.col("near") != F.col("n_fallback_nearest")).cast("int") + (F.col("half") != F.col("n_fallback_half")).cast("int")
    seen = {"told": F.col("told"), "n": F.col("n"), "near": F.col("near"), "half": F.col("half"), "off": off}
    return finding(p, "role_reasons", seen, (off > 0, "FAIL", "fallback counts disagree with the reasons"), (F.col("told") != F.col("n"), "FAIL", "reasons do not cover the trajectories"), (F.col("main") > 1, "FAIL", "several main referees"), (F.col("assistants") > 2, "FAIL", "more than two assistants"), (F.col("half") > 0, "WARN", "trajectories placed by their half"))


def refine(det: DataFrame, merges: DataFrame | None = None, tau: float = 0.25) -> DataFrame:
    """Rows neither gained nor lost, one row per frame and trajectory, numbers constant on it.

    merges: seq, kept, absorbed, distance of every merge. Trajectories before less merges must be those after, no
    absorbed one may be left, and no distance may be unknown or over tau.
    """
    slot = det.where("track_id IS NOT NULL").groupBy("seq", "image_id", "track_id").agg(F.count("*").alias("n"))
    hits = slot.groupBy("seq").agg(F.count_if(F.col("n") > 1).alias("collisions"))
    numbers = det.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.count_distinct("number").alias("k")).groupBy("seq").agg(F.count_if(F.col("k") > 1).alias("mixed"))
    rows = det.groupBy("seq").agg(F.count("track_id_prerefine").alias("before"), F.count("track_id").alias("after"), F.count_distinct("track_id_prerefine").alias("parts"), F.count_distinct("track_id").alias("whole"))
    per = rows.join(hits, "seq", "left").join(numbers, "seq", "left")
    seen = ["before", "after", "collisions", "mixed"]
    rules = [(F.col("after") > F.col("before"), "FAIL", "tracked rows appeared"), (F.col("collisions") > 0, "FAIL", "two rows of a trajectory in a frame"), (F.col("mixed") > 0, "FAIL", "numbers differ on a trajectory")]
    if merges is not None:
        left = det.where("track_id IS NOT NULL").select("seq", F.col("track_id").alias("absorbed")).distinct().withColumn("left", F.lit(True))
        log = merges.select("seq", "absorbed", "distance").join(left, ["seq", "absorbed"], "left")
        log = log.groupBy("seq").agg(F.count("*").alias("merges"), F.count_if(~F.coalesce(F.col("distance") <= tau, F.lit(False))).alias("far"), F.count("left").alias("undead"))
        per = per.join(log, "seq", "left").na.fill(0, ["merges", "far", "undead"]).withColumn("unexplained", F.col("parts") - F.col("merges") - F.col("whole"))
        seen += ["merges", "far", "undead", "unexplained"]
        rules += [(F.col("unexplained") != 0, "FAIL", "merges do not add up"), (F.col("undead") > 0, "FAIL", "an absorbed trajectory is left"), (F.col("far") > 0, "FAIL", "a merge beyond the limit")]
    return finding(per, "traj_refine", {c: F.col(c) for c in seen}, *rules)


def voted(det: DataFrame, source: str, result: str) -> DataFrame:
    """The voted column is constant on a track and equals the detected one."""
    t = det.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.count_distinct(result).alias("k"), F.count_if(~F.col(result).eqNullSafe(F.col(source))).alias("d"))
    per = t.groupBy("seq").agg(F.count_if(F.col("k") > 1).alias("mixed"), F.count_if(F.col("d") > 0).alias("changed"))
    return finding(per, "tracklet_agg", {"mixed": F.col("mixed"), "changed": F.col("changed")}, (F.col("mixed") > 0, "FAIL", "not constant"), (F.col("changed") > 0, "WARN", "differs from the detection"))


def drawable(det: DataFrame) -> DataFrame:
    """Rows with a place on the pitch but no colour."""
    colour = F.coalesce(F.col("role") == "referee", F.lit(False)) | F.coalesce(F.col("team").isin("left", "right"), F.lit(False))
    per = det.groupBy("seq").agg(F.count_if(tracks.located() & ~colour).alias("blank"))
    return finding(per, "visualization", {"blank": F.col("blank")}, (F.col("blank") > 0, "WARN", "drawable rows without colour"))


def population(det: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: entirely null fails, partly null warns."""
    parts = []
    for c in columns:
        per = det.groupBy("seq").agg(F.count(c).alias("k"), F.count("*").alias("n"))
        parts.append(finding(per, c, {"share": share(F.col("k"), F.col("n"))}, (F.col("k") == 0, "FAIL", "empty column"), (F.col("k") < F.col("n"), "WARN", "partly empty")))
    return audit(*parts)


def not_constant(det: DataFrame, column: str) -> DataFrame:
    """Tracks with more than one value of the column."""
    return det.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.count_distinct(column).alias("k")).where("k > 1").select("seq", "track_id")


def lineage(eligible: DataFrame, cached: DataFrame, detected: DataFrame, voted_: DataFrame) -> DataFrame:
    """Tracks that are lost between two hops: eligible, cached answer, detection column, voted column."""
    hops = (("cache", eligible, cached), ("detection", cached, detected), ("voted", detected, voted_))
    return reduce(DataFrame.unionByName, [a.select("seq", "track_id").distinct().join(b.select("seq", "track_id"), ["seq", "track_id"], "left_anti").withColumn("lost_before", F.lit(n)) for n, a, b in hops])


def agreement(sidecar: DataFrame, rows: DataFrame) -> DataFrame:
    """Trajectories whose sidecar role or team differs from the columns."""
    one = rows.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.max("role").alias("r"), F.max("team").alias("t"))
    return sidecar.join(one, ["seq", "track_id"], "full_outer").where(~F.col("role").eqNullSafe(F.col("r")) | ~F.col("team").eqNullSafe(F.col("t"))).select("seq", "track_id", "role", "r", "team", "t")


def collisions(det: DataFrame) -> DataFrame:
    """(frame, track) slots with several rows: the stages' own check."""
    return det.where("track_id IS NOT NULL").groupBy("seq", "image_id", "track_id").agg(F.count("*").alias("n")).where("n > 1")


# Patterns of failure in run logs (fixed values).
FAILURES = ("Traceback", "CUDA out of memory", "produced no JSON", "Killed", "RuntimeError")


def log_failures(lines: DataFrame, patterns: tuple = FAILURES) -> DataFrame:
    """Lines of value per pattern they match."""
    return lines.select(F.explode(F.array(*[F.when(F.col("value").rlike(p), F.lit(p)) for p in patterns])).alias("pattern")).where("pattern IS NOT NULL").groupBy("pattern").agg(F.count("*").alias("n"))
