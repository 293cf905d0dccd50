"""Reading shirt numbers: per-frame decoding, per-label statistics and the fusion of two readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEVER = float("-inf")
#: Digits and the end mark.
SYMBOLS = 11


def best_log_share(v: Column) -> Column:
    """Largest entry of the log softmax. Vectors of SYMBOLS entries are added up entry by entry, which Spark compiles; it interprets functions of an array."""
    m = F.array_max(v)
    plain = sum((F.exp(F.get(v, F.lit(k)) - m) for k in range(SYMBOLS)), F.lit(0.0))
    return m - (m + F.ln(F.when(F.size(v) == SYMBOLS, plain).otherwise(F.aggregate(v, F.lit(0.0), lambda s, y: s + F.exp(y - m)))))


def first_max(v: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def label_of(tens: Column, units: Column) -> Column:
    """Digits up to the first end mark (position 10); none is -1."""
    return F.when(tens == 10, F.lit("-1")).when(units == 10, tens.cast("string")).otherwise(F.concat(tens.cast("string"), units.cast("string")))


def decoded(reads: DataFrame, tens: str = "tens", units: str = "units") -> DataFrame:
    """Adds label, raw (joint log likelihood of the chosen symbols) and conf (the same, normalised, as a probability)."""
    t, u = F.col(tens), F.col(units)
    out = reads.withColumns({"_ti": first_max(t), "_ui": first_max(u)})
    raw = F.array_max(t) + F.array_max(u)
    conf = F.exp(best_log_share(t) + best_log_share(u))
    return out.withColumns({"label": label_of(F.col("_ti"), F.col("_ui")), "raw": raw, "conf": conf}).drop("_ti", "_ui")


def label_stats(frames: DataFrame, *by: str) -> DataFrame:
    """Per label: mx (largest raw), conf_sum, votes, strength (sum of raw), psum (sum of exp raw)."""
    return frames.groupBy(*by, "label").agg(F.max("raw").alias("mx"), F.sum("conf").alias("conf_sum"), F.count("*").alias("votes"), F.sum("raw").alias("strength"), F.sum(F.exp("raw")).alias("psum"))


def pooled(stats: DataFrame, *by: str) -> DataFrame:
    """Statistics of several readers or merged tracks as one: mx is the largest, the others add."""
    return stats.groupBy(*by, "label").agg(F.max("mx").alias("mx"), F.sum("conf_sum").alias("conf_sum"), F.sum("votes").alias("votes"), F.sum("strength").alias("strength"))


def maxconf(mx: Column | str = "mx", conf_sum: Column | str = "conf_sum") -> Column:
    return F.coalesce(F.exp(mx) * (F.col(conf_sum) if isinstance(conf_sum, str) else conf_sum), F.lit(0.0))


#: Decimals to which scores and strengths are rounded before they are compared, so that sums in another order tie alike.
EXACT = 9


def tied(score: Column, votes: Column, strength: Column, label: Column, decimals: int = EXACT) -> Column:
    """Order of labels: score, votes, strength, then the label as text."""
    return F.struct(F.round(score, decimals).alias("a"), votes.alias("b"), F.round(strength, decimals).alias("c"), label.alias("d"))


def ranked(stats: DataFrame, *by: str) -> DataFrame:
    """Adds rank by maxconf score and the tie rule, best first."""
    key = tied(maxconf(), F.col("votes"), F.col("strength"), F.col("label"))
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(key.desc())))


def vote_pool(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """The production rule: most pooled votes; share is that of the pooled votes."""
    return most_votes(pooled(a.select(*by, "label", "mx", "conf_sum", "votes", "strength").unionByName(b.select(*by, "label", "mx", "conf_sum", "votes", "strength")), *by), *by)


def most_votes(p: DataFrame, *by: str) -> DataFrame:
    """The label with most votes of pooled statistics."""
    best = F.max_by(F.struct("label", "votes"), tied(F.col("votes").cast("double"), F.col("votes"), F.col("strength"), F.col("label")))
    return p.groupBy(*by).agg(best.alias("x"), F.sum("votes").alias("all")).select(*by, F.col("x.label").alias("label"), (F.col("x.votes") / F.col("all")).alias("share"))


def fusion_rules() -> dict[str, Column]:
    """Score of a label under each rule, from the two readers' maxconf (ma, mb), votes (va, vb), mx and conf_sum."""
    ma, mb, va, vb = (F.col(c) for c in ("ma", "mb", "va", "vb"))
    joint = F.exp(F.greatest("amx", "bmx")) * (F.coalesce("acs", F.lit(0.0)) + F.coalesce("bcs", F.lit(0.0)))
    return {
        "a_maxconf": F.when(va > 0, ma), "b_maxconf": F.when(vb > 0, mb), "vote_pool": (va + vb).cast("double"), "a_mc_x_bcount": ma * vb, "b_mc_x_acount": mb * va,
        "a_mc_x_bcount1": ma * (1 + vb), "b_mc_x_acount1": mb * (1 + va), "sum": ma + mb, "prod": ma * mb, "prod_plus1": (1 + ma) * (1 + mb) - 1, "joint_maxconf": joint,
    }


def fuse(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """One column per rule with the winning label of each track; a rule without candidates gives -1."""
    left = a.select(by, "label", *[F.col(c).alias("a" + n) for c, n in (("mx", "mx"), ("conf_sum", "cs"), ("votes", "v"), ("strength", "s"))])
    right = b.select(by, "label", *[F.col(c).alias("b" + n) for c, n in (("mx", "mx"), ("conf_sum", "cs"), ("votes", "v"), ("strength", "s"))])
    zero = F.lit(0)
    j = left.join(right, [by, "label"], "full_outer").withColumns({"ma": maxconf("amx", "acs"), "mb": maxconf("bmx", "bcs"), "va": F.coalesce("av", zero), "vb": F.coalesce("bv", zero)})
    j = j.withColumn("st", F.coalesce("as", F.lit(0.0)) + F.coalesce("bs", F.lit(0.0)))
    own = {"a_maxconf": ("va", "as"), "b_maxconf": ("vb", "bs")}
    cols = {}
    for name, score in fusion_rules().items():
        votes, strength = (F.col(own[name][0]), F.col(own[name][1])) if name in own else (F.col("va") + F.col("vb"), F.col("st"))
        key = F.when(score.isNotNull(), tied(score, votes, strength, F.col("label")))
        cols[name] = F.coalesce(F.max_by("label", key), F.lit("-1"))
    out = j.groupBy(by).agg(*[c.alias(n) for n, c in cols.items()])
    return out.withColumn("agree_first", F.when(F.col("a_maxconf") == F.col("b_maxconf"), F.col("a_maxconf")).otherwise(F.col("joint_maxconf")))


def single_rules(stats: DataFrame, by: str) -> DataFrame:
    """Winners of one reader by vote, wvote (votes times confidence), slogconf and maxconf, with their share of all scores."""
    score = {"vote": F.col("votes").cast("double"), "wvote": F.col("votes") * F.col("conf_sum"), "slogconf": F.col("psum") * F.col("conf_sum"), "maxconf": maxconf()}
    aggs = []
    for name, s in score.items():
        best = F.max(F.struct(tied(s, F.col("votes"), F.col("strength"), F.col("label")).alias("k"), s.alias("s")))
        aggs += [best["k"]["d"].alias(name), (best["s"] / F.sum(s)).alias(f"{name}_share")]
    return stats.groupBy(by).agg(*aggs)


def position_sums(reads: DataFrame, by: str, min_conf: float | None = None) -> DataFrame:
    """The sum rule: log likelihoods add up per position and symbol; sum_conf is the mean per frame and kept position."""
    both = ("tens", "units")
    sums = reads.groupBy(by).agg(F.count("*").alias("n"), *[F.max(F.size(c) > 0).alias(f"{c}_any") for c in both], *[F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c in both for k in range(SYMBOLS)])
    top = {c: F.greatest(*[F.struct(F.round(f"{c}{k}", EXACT).alias("s"), F.lit(-k).alias("p")) for k in range(SYMBOLS)]) for c in both}
    j = sums.where("tens_any AND units_any").select(by, "n", *[top[c].alias(c) for c in both])
    j = j.select(by, "n", *[x for c in both for x in ((-F.col(f"{c}.p")).alias(f"{c}_i"), F.col(f"{c}.s").alias(f"{c}_s"))])
    conf = F.when(F.col("tens_i") != 10, F.when(F.col("units_i") != 10, (F.col("tens_s") + F.col("units_s")) / 2).otherwise(F.col("tens_s")) / F.col("n"))
    label = label_of(F.col("tens_i"), F.col("units_i"))
    if min_conf is not None:
        label = F.when(conf < min_conf, F.lit("-1")).otherwise(label)
    return j.select(by, label.alias("sum"), conf.alias("sum_conf"), F.exp(F.col("tens_s") + F.col("units_s")).alias("sumexp_conf"))


def passes(legible: float = 0.5, detector: float = 0.52) -> Column:
    """Both gates, each strict."""
    return (F.col("legibility") > legible) & (F.col("det_score") > detector)


def gated(reads: DataFrame, legible: float = 0.5, detector: float = 0.52) -> DataFrame:
    """Reads that pass both gates, each strict. Scores are stored ungated, so thresholds are query parameters."""
    return reads.where(passes(legible, detector))


def keep_some(rows: DataFrame, by: str, p: str, threshold: float) -> DataFrame:
    """Rows with p below the threshold; a group without one keeps those with its least p, flagged."""
    w = Window.partitionBy(by)
    some = F.bool_or(F.col(p) < threshold).over(w)
    return rows.withColumn("_some", some).withColumn("_min", F.min(p).over(w)).where(F.when(F.col("_some"), F.col(p) < threshold).otherwise(F.col(p) == F.col("_min"))).withColumn("kept_by_minimum", ~F.col("_some")).drop("_some", "_min")


# Pairs of rules whose agreement is reported (fixed values).
AGREEMENTS = (("sum", "vote"), ("vote", "wvote"), ("sum", "wvote"), ("wvote", "slogconf"), ("wvote", "maxconf"), ("sum", "sumexp"))


def rule_agreement(stats: DataFrame, reads: DataFrame, by: str, min_conf: float | None = None) -> DataFrame:
    """Winners of all rules of one reader side by side, a flag per pair of AGREEMENTS, and ``agree`` for sum and vote."""
    sums = position_sums(reads, by, min_conf)
    if min_conf is None:
        sums = sums.withColumn("sumexp", F.col("sum"))
    else:
        sums = sums.join(position_sums(reads, by).select(by, F.col("sum").alias("sumexp")), by)
    out = single_rules(stats, by).join(sums, by)
    return out.withColumns({f"agree_{a}_{b}": F.col(a) == F.col(b) for a, b in AGREEMENTS} | {"agree": F.col("sum") == F.col("vote")})


def gate_sweep(reads_a: DataFrame, reads_b: DataFrame, truth: DataFrame, by: str, thresholds: list[float], detector: float = 0.52) -> DataFrame:
    """Accuracy of the pooled vote at each legibility threshold from one ungated table: threshold, answered, correct, n. truth: by, number."""

    def stats(reads):
        t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
        rows = reads.select("*", t).where((F.col("legibility") > F.col("threshold")) & (F.col("det_score") > detector))
        return label_stats(decoded(rows), "threshold", by)

    won = vote_pool(stats(reads_a), stats(reads_b), "threshold", by)
    n = truth.agg(F.count("*").alias("n"))
    hit = won.join(truth, by).groupBy("threshold").agg(F.count("*").alias("answered"), F.count_if(F.col("label") == F.col("number")).alias("correct"))
    return hit.crossJoin(n)  # one row
