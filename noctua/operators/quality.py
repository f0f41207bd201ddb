"""Frame quality: drop policy, role selection, pairs, pairwise evaluation and rankings."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.functions import scalar as S
from noctua.operators.stats import _join, counted, medians, nearest_rank, numbered, quantiles, ranked
from noctua.session import written

# --- X1: metrics ---------------------------------------------------------------------------------------------------------

#: Name -> builder of the score from (stars, flux, background, noise) columns.
METRICS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "star_yield": lambda stars, flux, background, noise: S.star_yield(stars, noise),
    "stellar_contrast": lambda stars, flux, background, noise: S.stellar_contrast(flux, noise),
    "sky_weighted_contrast": S.sky_weighted_contrast,
    "stellar_quality": S.stellar_quality,
}
RECOMMENDED = "stellar_quality"


def register_metric(name: str, build: Callable[[Column, Column, Column, Column], Column]) -> None:
    """Add a metric; a name is taken once."""
    if name in METRICS:
        raise ValueError(f"metric {name!r} exists")
    METRICS[name] = build


def metric_scores(features: DataFrame, stars: str, flux: str, background: str, noise: str, names: list[str] | None = None) -> DataFrame:
    """One column for each metric; non-finite features and results are NULL."""
    cols = [S.finite(F.col(c)) for c in (stars, flux, background, noise)]
    return features.withColumns({n: S.finite(METRICS[n](*cols)) for n in names or METRICS})


#: Fixed values of P24: exponents of the star count (None: log1p instead), the flux, the noise and the background.
SWEEP = (0.0, 0.25, 0.5, 0.75, None), (0.75, 1.0, 1.25), (0.5, 1.0, 1.5), (0.25, 0.5, 1.0)


def formula_sweep(features: DataFrame, key: str, stars: str, flux: str, background: str, noise: str) -> DataFrame:
    """The score of every row under each of the 135 formulas: key, formula, score.

    The formulas are literals beside each row, exploded, so features are read once and nothing is shuffled."""
    grid = [F.struct(F.lit(i).alias("formula"), F.lit(s).cast("double").alias("s"), F.lit(f).alias("f"), F.lit(n).alias("n"), F.lit(b).alias("b")) for i, (s, f, n, b) in enumerate(product(*SWEEP))]
    rows = features.select(key, *[S.finite(F.col(c)).alias(a) for c, a in ((stars, "_s"), (flux, "_f"), (background, "_b"), (noise, "_n"))], F.explode(F.array(*grid)).alias("p"))
    count = F.greatest(F.col("_s"), F.lit(0.0))
    term = F.when(F.col("p.s").isNull(), F.log1p(count)).otherwise(F.pow(count, F.col("p.s")))
    down = F.pow("_n", F.col("p.n")) * F.pow(F.greatest(F.col("_b"), F.lit(S.EPS)), F.col("p.b"))
    ok = (F.col("_n") > 0) & F.col("_s").isNotNull() & F.col("_b").isNotNull()
    return rows.select(key, F.col("p.formula").alias("formula"), F.when(ok, S.finite(term * S.signed_power(F.col("_f"), F.col("p.f")) / down)).alias("score"))


# --- W4, W5, L12 -----------------------------------------------------------------------------------------------------------


def drop_policy(df: DataFrame, keys: list[str], score: str, path: str, min_frames: int = 3, fraction: float = 0.15) -> DataFrame:
    """Rows with drop_status, quality_rank, sequence_index and threshold.

    Valid rows have a finite score.  In a group with fewer than min_frames of them all are too_few_valid_scores.  The first
    by (score desc, path) is the reference.  Threshold: Q1 - 1.5 IQR by nearest rank; rows below it are dropped, worst
    first and of equal scores by path, at most floor(valid * fraction) of them and never the reference; if fewer than
    min_frames would stay, the best of the dropped, of equal scores by path, are restored.  quality_rank is the place of a valid
    row by (score desc, path); sequence_index counts kept rows in that order.  Others: skipped_invalid_score.
    """
    rows = df.withColumn("_s", S.finite(F.col(score)))
    # of each score: _less rows are worse, _same are equal; of each group: quartiles and the number of rows that go at first
    values = written(ranked(counted(rows, keys, "_s"), keys).select(*keys, F.col("x").alias("_s"), F.col("c").alias("_same"), (F.col("upto") - F.col("c")).alias("_less"), F.col("n").alias("_n")), "score-ranks")
    at = lambda q: F.min(F.when(F.col("_less") + F.col("_same") > S.half_even(q * (F.col("_n") - 1)), F.col("_s")))
    q = values.groupBy(*keys).agg(at(0.25).alias("_q1"), at(0.75).alias("_q3")).withColumn("threshold", F.col("_q1") - 1.5 * (F.col("_q3") - F.col("_q1")))
    out = _join(values, q, keys).groupBy(*keys).agg(F.first("threshold").alias("threshold"), F.first("_n").alias("_valid"), F.coalesce(F.sum(F.when(F.col("_s") < F.col("threshold"), F.col("_same"))), F.lit(0)).alias("_out"))
    out = out.withColumn("_bad", F.least("_out", F.floor(F.col("_valid") * fraction))).withColumn("_back", F.greatest(F.lit(min_frames) - (F.col("_valid") - F.col("_bad")), F.lit(0)))
    valid = numbered(rows.where("_s is not null"), keys, [F.desc("_s"), F.asc(path)], "_rank")
    rows = valid.unionByName(rows.where("_s is null").withColumn("_rank", F.lit(None).cast("long")))
    rows = _join(_join(rows, values.drop("_n"), [*keys, "_s"], "left"), out, keys, "left")
    # the place among equals by path, the place from the worst, and the place from the best of those that go
    rank, n, bad = F.col("_rank"), F.col("_valid"), F.col("_bad")
    among = rank - (n - F.col("_less") - F.col("_same"))
    edge = (F.col("_less") < bad) & (F.col("_less") + F.col("_same") >= bad)  # the score at which the dropped end
    goes = F.col("_less") + among <= bad
    gone = goes & (F.when(edge, among).otherwise(rank - (n - bad)) > F.col("_back"))
    few = F.coalesce(n < min_frames, F.lit(True))
    status = (
        F.when(rank.isNull(), "skipped_invalid_score").when(few, "too_few_valid_scores").when(rank == 1, "reference")
        .when(gone, "dropped_quality_outlier").otherwise("kept")
    )
    before = F.when(edge & ~goes, F.greatest(bad - F.col("_less") - F.col("_back"), F.lit(0))).otherwise(0)  # equals that went, which come first by path
    kept = F.col("drop_status").isin("reference", "kept")
    rows = rows.withColumn("drop_status", status).withColumns({"sequence_index": F.when(kept, rank - before), "quality_rank": rank})
    return rows.select(*df.columns, "threshold", "drop_status", "sequence_index", "quality_rank")


def kept_frames(status: DataFrame) -> DataFrame:
    """U4: of the rows of drop_policy those that stay: the valid ones less the dropped."""
    return status.where(F.col("drop_status").isin("reference", "kept"))


def group_plan(status: DataFrame, keys: list[str]) -> DataFrame:
    """For each group frames, kept, dropped and the reason why it is not run (NULL: it is)."""
    kept = F.count_if(F.col("drop_status").isin("reference", "kept"))
    few = F.count_if(F.col("drop_status") == "too_few_valid_scores")
    return status.groupBy(*keys).agg(F.count("*").alias("frames"), kept.alias("kept"), F.count_if(F.col("drop_status") == "dropped_quality_outlier").alias("dropped"), F.when(kept == 0, F.when(few > 0, "too_few_valid_scores").otherwise("no_valid_scores")).alias("reason"))


# --- G10, O1 ---------------------------------------------------------------------------------------------------------------


def score_block(df: DataFrame, keys: list[str], score: str, path: str, least: int = 1) -> DataFrame:
    """N, best_path, best_score, median, p10 and below_p10 for each group of at least `least` scored rows; groups
    without scores are kept with n = 0."""
    x = df.withColumn("_s", S.finite(F.col(score)))
    got = x.groupBy(*keys).agg(F.min_by(path, F.when(F.col("_s").isNotNull(), F.struct(-F.col("_s"), F.col(path)))).alias("best_path"), F.max("_s").alias("best_score"))
    got = _join(got, quantiles(x, keys, "_s", [0.5, 0.1], ["median", "p10"]), keys)
    below = _join(x, got.select(*keys, "p10"), keys).groupBy(*keys).agg(F.count_if(F.col("_s") < F.col("p10")).alias("below_p10"))
    return _join(got, below, keys).where((F.col("n") >= least) | (F.col("n") == 0))


def best_and_worst(df: DataFrame, keys: list[str], score: str, path: str, k: int = 3) -> DataFrame:
    """O1: the k best and k worst scored rows of each group, with side and place."""
    x = df.withColumn("_s", S.finite(F.col(score))).where("_s is not null")
    sides = []
    for side, order in (("best", F.desc("_s")), ("worst", F.asc("_s"))):
        sides.append(x.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, path))).where(F.col("place") <= k).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1]).drop("_s")


# --- W6-W8, O4 -------------------------------------------------------------------------------------------------------------


def select_roles(df: DataFrame, keys: list[str], path: str, score: str, noise: str, background: str, stars: str) -> DataFrame:
    """Keys, path, roles (sorted by priority) and primary_role of the frames that a test set takes from each group.

    Reference ranks 1 to 3 by score (desc, path desc), quartile roles by nearest rank, and extremes of three metrics; a
    frame may have several roles."""
    cols = {"score": score, "bgnoise": noise, "background": background, "star_count": stars}
    x = df.select(*keys, F.col(path).alias("_path"), *[S.finite(F.col(c)).alias(n) for n, c in cols.items()])
    extremes = {"max_bgnoise": ("bgnoise", F.max), "max_background": ("background", F.max), "min_star_count": ("star_count", F.min), "max_star_count": ("star_count", F.max)}
    best = x.groupBy(*keys).agg(*[of(F.when(F.col(c).isNotNull(), F.struct(c, "_path"))).alias(f"_{role}") for role, (c, of) in extremes.items()])
    # the scored rows in rising order of (score, path); from the other end the same order falls
    up = numbered(x.where("score is not null"), keys, ["score", "_path"], "_up", "_n").select(*keys, "_path", *cols, "_up", "_n")
    rest = x.where("score is null").withColumns({"_up": F.lit(None).cast("long"), "_n": F.lit(None).cast("long")})
    x = _join(up.unionByName(rest.select(*up.columns)), best, keys)
    marks = [F.when(F.col("_n") - F.col("_up") + 1 == i, f"reference_rank_{i}") for i in (1, 2, 3)]
    for q, role in ((0.5, "score_median"), (0.1, "score_p10"), (0.25, "score_p25"), (0.75, "score_p75")):
        marks.append(F.when(F.col("_up") == S.half_even(q * (F.col("_n") - 1)) + 1, role))
    for role, (c, _) in extremes.items():
        marks.append(F.when((F.col(f"_{role}.{c}") == F.col(c)) & (F.col(f"_{role}._path") == F.col("_path")), role))
    roles = F.array_compact(F.array(*marks))
    ordered = F.transform(F.array_sort(F.transform(roles, lambda r: F.struct(S.lookup(S.ROLE_PRIORITY, r).alias("p"), r.alias("r")))), lambda s: s["r"])
    return x.withColumn("roles", ordered).where(F.size("roles") > 0).select(*keys, F.col("_path").alias(path), "roles", S.primary_role(F.col("roles")).alias("primary_role"))


def usable_illumination(status: Column, valid: Column, score: Column, least: float = 0.45) -> Column:
    """Whether a frame was measured, over enough of its tiles, and has a score."""
    return (F.coalesce(status, F.lit("")) == "success") & (F.coalesce(S.finite(valid), F.lit(0.0)) >= least) & S.finite(score).isNotNull()


def target_strength(pct: dict[str, str]) -> Column:
    """How strong a frame's gradient is, from the percentile columns range, gradient, patchiness and background."""
    c = {k: F.coalesce(S.finite(F.col(v)), F.lit(0.0)) for k, v in pct.items()}
    return F.greatest(c["range"], c["gradient"], c["patchiness"], 0.5 * c["background"] + 0.5 * c["gradient"])


def blended_roles(df: DataFrame, keys: list[str], path: str, pct: dict[str, str], valid: str, refs: int = 2, usable: Column | None = None) -> DataFrame:
    """Keys, path, role, strength: `refs` references for each group of 3 or more usable rows, and the best other row
    for each target role.

    pct names the percentile columns score, stars, flux, background, gradient, r2, patchiness, range; a missing
    percentile, and one of 0, counts as 0.5 where a low one is wanted; a missing one as 0 for score, stars and valid.
    Strengths that agree to nine digits, which sums of the same shares in another order can miss by a bit, are a tie, and the larger path wins."""
    c = {k: S.finite(F.col(v)) for k, v in pct.items()}
    mid, none = lambda x: F.when(x != 0, x).otherwise(0.5), lambda x: F.coalesce(x, F.lit(0.0))
    df = df if usable is None else df.where(usable)
    flat = 1 - F.greatest(mid(c["range"]), mid(c["gradient"]), mid(c["patchiness"]))
    x = df.withColumn("_ref", 0.55 * none(c["score"]) + 0.30 * flat + 0.10 * none(S.finite(F.col(valid))) + 0.05 * none(c["stars"]))
    x = x.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n >= 3")
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("_ref", 9)), F.desc(path))))
    targets = {
        "illum_gradient_high": (c["gradient"] + c["r2"]) / 2, "illum_patchy_high": c["patchiness"], "illum_range_high": c["range"], "bright_gradient": 0.5 * c["background"] + 0.5 * c["gradient"],
        "cloud_suspect": 0.55 * c["patchiness"] + 0.225 * (1 - mid(c["stars"])) + 0.225 * (1 - mid(c["flux"])),
    }
    first = x.where(F.col("_k") <= refs).select(*keys, path, F.concat(F.lit("illum_reference_rank_"), F.col("_k").cast("string")).alias("role"), F.col("_ref").alias("strength"))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), v.alias("strength")) for r, v in targets.items()])
    rest = x.where(F.col("_k") > refs).select(*keys, path, F.explode(roles).alias("r")).where("r.strength is not null")
    rest = rest.groupBy(*keys, "r.role").agg(F.max(F.struct(F.round("r.strength", 9).alias("rounded"), path, "r.strength")).alias("m")).select(*keys, f"m.{path}", "role", "m.strength")
    return first.unionByName(rest)


def smoke_subset(roles: DataFrame, keys: list[str], path: str, wanted: list[str], size: int = 6) -> DataFrame:
    """From each group the first row (by path) of every wanted role in order, filled up by other rows to `size`."""
    ask = F.array(*[F.lit(w) for w in wanted])
    has = F.array_intersect(ask, F.col("roles"))
    by_role = roles.withColumn("_role", F.explode_outer(has)).withColumn("_first", F.row_number().over(Window.partitionBy(*keys, "_role").orderBy(path)))
    chosen = F.min(F.when(F.col("_role").isNotNull() & (F.col("_first") == 1), F.array_position(ask, F.col("_role"))))
    rows = by_role.groupBy(*keys, path).agg(chosen.alias("_place"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_place").asc_nulls_last(), path))).where((F.col("place") <= size) | F.col("_place").isNotNull()).drop("_place")


def top_groups(df: DataFrame, key: str, strength: str, k: int) -> DataFrame:
    """Rows of the k groups with the greatest strength; ties to the larger key."""
    best = df.groupBy(key).agg(F.max(strength).alias("_m")).orderBy(F.desc("_m"), F.desc(key)).limit(k)
    return df.join(F.broadcast(best.select(key)), key, "left_semi")  # k rows


# --- J4-J7, J13, G46, O2, O3, O8 ----------------------------------------------------------------------------------------------


def sequential_pairs(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Each frame with the next one of its group."""
    return df.select(*keys, F.col(path).alias("left_path"), F.lead(path).over(Window.partitionBy(*keys).orderBy(path)).alias("right_path")).where("right_path is not null")


def candidate_pairs(df: DataFrame, keys: list[str], path: str, seed: int, limit: int | None = None) -> DataFrame:
    """Unordered pairs inside a group in a seeded order; the order comes from a hash, so reruns and partitions agree.

    All pairs are the point here: they are candidates for labels, of groups the size of a night's frames; `limit` takes
    the first ones by hash."""
    a = df.select(*keys, F.col(path).alias("left_path"))
    b = df.select(*keys, F.col(path).alias("right_path"))
    pairs = a.join(b, keys).where("left_path < right_path").withColumn("shuffle_key", F.xxhash64(F.lit(seed), "left_path", "right_path"))
    return pairs.orderBy("shuffle_key", "left_path", "right_path").limit(limit) if limit else pairs


def unlabelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that no label has, whichever side is left."""
    sides = lambda d: (F.least(d["left_path"], d["right_path"]), F.greatest(d["left_path"], d["right_path"]))
    known = labels.select(F.least("left_path", "right_path").alias("_a"), F.greatest("left_path", "right_path").alias("_b")).distinct()
    a, b = sides(pairs)
    return pairs.join(known, (a == known["_a"]) & (b == known["_b"]), "left_anti")


#: Tasks over which the frames of a group are dealt to meet its references.
PARTS = 16


def role_pairs(df: DataFrame, keys: list[str], path: str, reference: Column) -> DataFrame:
    """Every reference of a group with every other frame of it.

    The pairs are as many as the product of both; a group's frames are dealt over PARTS tasks, to each of which its few references go."""
    marked = df.withColumn("_ref", reference)
    refs = marked.where("_ref").select(*keys, F.col(path).alias("reference_path"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    others = marked.where("not _ref").select(*keys, F.col(path).alias("target_path"), F.pmod(F.xxhash64(path), F.lit(PARTS)).cast("int").alias("_part"))
    return refs.join(others, [*keys, "_part"]).drop("_part")


def with_scores(labels: DataFrame, scores: DataFrame, path: str, score: str) -> DataFrame:
    """Labels with the finite scores of both sides."""
    s = scores.select(F.col(path).alias("_p"), S.finite(F.col(score)).alias("_v"))
    left = labels.join(s, F.col("left_path") == F.col("_p"), "left").withColumnRenamed("_v", "left_score").drop("_p")
    return left.join(s, F.col("right_path") == F.col("_p"), "left").withColumnRenamed("_v", "right_score").drop("_p")


def judged_pairs(scored: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Each label with outcome (rejected, tie, skipped, correct, violation) and severity."""
    delta = F.col("left_score") - F.col("right_score")
    right = F.when(F.col("winner") == "left", delta > epsilon).otherwise(delta < -epsilon)
    outcome = F.when(F.col("winner") == "reject", "rejected").when(F.col("winner") == "tie", "tie").when(delta.isNull(), "skipped").when(right, "correct").otherwise("violation")
    severity = F.when(F.col("winner") == "left", F.greatest(epsilon - delta, F.lit(0.0))).otherwise(F.greatest(delta + epsilon, F.lit(0.0)))
    return scored.withColumn("outcome", outcome).withColumn("severity", F.when(F.col("outcome") == "violation", severity))


def evaluation(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Total, correct, rejected, skipped, violations, severity and accuracy (NULL without decided labels)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    got = judged.groupBy(*keys).agg((n("correct") + n("violation")).alias("total"), n("correct").alias("correct"), n("rejected").alias("rejected"), n("skipped").alias("skipped"), n("violation").alias("violations"), F.coalesce(F.sum("severity"), F.lit(0.0)).alias("severity"))
    return got.withColumn("accuracy", F.try_divide(F.col("correct"), F.col("total")))


def rank_metrics(evaluated: DataFrame, name: str, top: int) -> DataFrame:
    """O2: accuracy desc (none: last), fewer violations, smaller severity, name."""
    return evaluated.orderBy(F.coalesce("accuracy", F.lit(-1.0)).desc(), "violations", "severity", name).limit(top)


def worst_violations(judged: DataFrame, top: int) -> DataFrame:
    """O3: violations by severity, ties by paths."""
    return judged.where("outcome = 'violation'").orderBy(F.desc("severity"), "left_path", "right_path").limit(top)


def label_page(labels: DataFrame, order: list[str], winners: list[str], start: int, limit: int) -> DataFrame:
    """Labels start to start + limit - 1 (from 1) of those with the given winners; of a rank over all labels, taken by
    range partition, the one window over the whole table that paging needs."""
    kept = labels.where(F.col("winner").isin(winners))
    first = kept.orderBy(*order).limit(start + limit - 1)
    return first.withColumn("row", F.row_number().over(Window.orderBy(*order))).where(F.col("row") >= start)


def clear_paths(labels: DataFrame) -> DataFrame:
    """Paths on either side of clear labels."""
    clear = labels.where(F.col("winner").isin("left", "right"))
    return clear.select(F.col("left_path").alias("path")).union(clear.select(F.col("right_path").alias("path"))).distinct()


def ab_summary(runs: DataFrame, keys: list[str], model: str, value: str, models: list[str]) -> DataFrame:
    """Pairs where all models have a value: wins of each (smaller is better, ties to none) and medians."""
    side = runs.groupBy(*keys).pivot(model, models).agg(F.first(value, ignorenulls=True))
    cols = [F.col(f"`{m}`") for m in models]
    full = side.where(F.coalesce(*[F.when(c.isNull(), F.lit(False)) for c in cols], F.lit(True)))
    best = F.least(*cols)
    wins = [F.count_if((c == best) & (sum((o == best).cast("int") for o in cols) == 1)).alias(f"wins_{m}") for c, m in zip(cols, models, strict=True)]
    full = written(full, "pairs")
    return full.agg(F.count("*").alias("pairs"), *wins).crossJoin(F.broadcast(medians(full, [], {f"median_{m}": m for m in models})))  # one row each


def before_after(pairs: DataFrame, metrics: DataFrame, before: str, after: str, key: str, value: str) -> DataFrame:
    """Before, after, delta and relative reduction (NULL if before is 0 or missing)."""
    m = metrics.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    x = pairs.join(m, F.col(before) == F.col("_k"), "left").withColumnRenamed("_v", "before").drop("_k")
    x = x.join(m, F.col(after) == F.col("_k"), "left").withColumnRenamed("_v", "after").drop("_k")
    return x.withColumn("delta", F.col("after") - F.col("before")).withColumn("reduction", F.try_divide(F.col("before") - F.col("after"), F.col("before")))


def runtime_rollup(runs: DataFrame, keys: list[str], seconds: str, total_frames: int) -> DataFrame:
    """Count, median and nearest-rank p90 of run times, and hours for `total_frames` at the median."""
    p90 = nearest_rank(runs, keys, seconds, [0.9], ["p90"])
    mid = medians(runs, keys, {"median": seconds})
    return _join(p90, mid, keys).withColumn("projected_hours", F.col("median") * total_frames / 3600)
