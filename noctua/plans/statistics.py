"""Queries of grouped statistics, fits, windows and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from noctua.operators import logs, quality, stats
from noctua.plans.base import Tables, query, r, rounded

NEAREST = "list_sort(list(x))[1 + CAST(round_even({q} * (count(x) - 1), 0) AS BIGINT)]"


@query("w5_drop_policy", f"""
WITH e AS (SELECT event_type, event_id, -value AS x FROM events WHERE isfinite(value)),
q AS (SELECT event_type, count(*) AS n, {NEAREST.format(q=0.25)} AS q1, {NEAREST.format(q=0.75)} AS q3 FROM e GROUP BY 1),
a AS (SELECT e.*, q.n, q1 - 1.5 * (q3 - q1) AS threshold, row_number() OVER (PARTITION BY e.event_type ORDER BY x DESC, event_id) AS rk FROM e JOIN q USING (event_type)),
b AS (SELECT *, (rk > 1 AND x < threshold) AS out FROM a),
w AS (SELECT *, out AND row_number() OVER (PARTITION BY event_type, out ORDER BY x, event_id) <= floor(n * 0.15) AS bad FROM b),
c AS (SELECT *, bad AND row_number() OVER (PARTITION BY event_type, bad ORDER BY x DESC, event_id) > greatest(3 - (n - count(*) OVER (PARTITION BY event_type, bad)), 0) AS dropped FROM w),
d AS (SELECT *, CASE WHEN n < 3 THEN 'too_few_valid_scores' WHEN rk = 1 THEN 'reference' WHEN dropped THEN 'dropped_quality_outlier' ELSE 'kept' END AS drop_status FROM c)
SELECT event_type, event_id, round(threshold, 6) AS threshold, drop_status,
  CASE WHEN drop_status IN ('reference', 'kept') THEN row_number() OVER (PARTITION BY event_type, drop_status IN ('reference', 'kept') ORDER BY x DESC, event_id) END AS sequence_index FROM d
""")
def _(t: Tables):
    got = quality.drop_policy(t.events.withColumn("score", -F.col("value")), ["event_type"], "score", "event_id")
    return got.where(F.col("value").isNotNull()).select("event_type", "event_id", r("threshold").alias("threshold"), "drop_status", F.col("sequence_index").cast("long").alias("sequence_index"))


@query("l12_group_plan", f"""
WITH e AS (SELECT p_brand, p_partkey, -p_retailprice AS x FROM part),
q AS (SELECT p_brand, count(*) AS n, {NEAREST.format(q=0.25)} AS q1, {NEAREST.format(q=0.75)} AS q3 FROM e GROUP BY 1),
a AS (SELECT e.*, q.n, q1 - 1.5 * (q3 - q1) AS threshold, row_number() OVER (PARTITION BY e.p_brand ORDER BY x DESC, p_partkey) AS rk FROM e JOIN q USING (p_brand)),
b AS (SELECT *, (rk > 1 AND x < threshold) AS out FROM a),
c AS (SELECT *, out AND row_number() OVER (PARTITION BY p_brand, out ORDER BY x, p_partkey DESC) <= least(floor(n * 0.15), greatest(n - 3, 0)) AS dropped FROM b)
SELECT p_brand, count(*) AS frames, CASE WHEN n < 3 THEN 0 ELSE count(*) FILTER (NOT dropped) END AS kept, count(*) FILTER (dropped AND n >= 3) AS dropped, CASE WHEN n < 3 THEN 'too_few_valid_scores' END AS reason FROM c GROUP BY p_brand, n
""")
def _(t: Tables):
    return quality.group_plan(quality.drop_policy(t.part.withColumn("score", -F.col("p_retailprice")), ["p_brand"], "score", "p_partkey"), ["p_brand"])


@query("g8_median_mad", """
WITH x AS (SELECT event_type, value AS x FROM events WHERE isfinite(value)), m AS (SELECT event_type, count(*) AS n, median(x) AS median FROM x GROUP BY 1)
SELECT event_type, n, round(median, 6) AS median, round(median(abs(x - median)), 6) AS mad, round(1.4826 * median(abs(x - median)), 6) AS sigma FROM x JOIN m USING (event_type) GROUP BY event_type, n, median
""")
def _(t: Tables):
    return rounded(stats.median_mad(t.events, ["event_type"], "value"))


@query("g9_nearest_rank", f"""
WITH x AS (SELECT event_type, value AS x FROM events WHERE isfinite(value))
SELECT event_type, count(*) AS n, {NEAREST.format(q=0.1)} AS q10, {NEAREST.format(q=0.25)} AS q25, {NEAREST.format(q=0.5)} AS q50, {NEAREST.format(q=0.75)} AS q75 FROM x GROUP BY 1
""")
def _(t: Tables):
    return stats.nearest_rank(t.events, ["event_type"], "value", [0.1, 0.25, 0.5, 0.75])


@query("g9_linear_quantiles", """
SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem GROUP BY 1
""")
def _(t: Tables):
    return rounded(stats.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.05, 0.95, 0.999], ["p05", "p95", "p999"]))


@query("g10_score_block", """
WITH g AS (SELECT p_brand, count(*) AS n, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS best_path, max(p_retailprice) AS best_score, median(p_retailprice) AS median, quantile_cont(p_retailprice, 0.1) AS p10 FROM part GROUP BY 1)
SELECT g.p_brand, n, best_path, best_score, round(median, 6) AS median, round(g.p10, 6) AS p10, (SELECT count(*) FROM part p WHERE p.p_brand = g.p_brand AND p.p_retailprice < g.p10) AS below_p10 FROM g WHERE n >= 2
""")
def _(t: Tables):
    got = quality.score_block(t.part, ["p_brand"], "p_retailprice", "p_partkey", 2)
    return rounded(got)


@query("g12_cdf", """
SELECT s_nationkey, s_suppkey, s_acctbal AS x, round(CASE WHEN count(*) OVER (PARTITION BY s_nationkey) > 1 THEN (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1) / (count(*) OVER (PARTITION BY s_nationkey) - 1) ELSE 0 END, 9) AS y FROM supplier
""")
def _(t: Tables):
    return stats.cdf(t.supplier, ["s_nationkey"], "s_acctbal", ["s_suppkey"]).select("s_nationkey", "s_suppkey", "x", r("y", 9).alias("y"))


@query("g13_histogram", """
WITH h AS (SELECT l_returnflag, CAST(least(floor(l_quantity / 5), 9) AS INTEGER) AS bin FROM lineitem WHERE l_quantity BETWEEN 0 AND 50)
SELECT l_returnflag, bin, count(*) AS count, bin * 5.0::DOUBLE AS "left", round(log10(count(*)), 9) AS log10_count, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) / 5, 9) AS density FROM h GROUP BY 1, 2
""")
def _(t: Tables):
    return rounded(stats.histogram(t.lineitem, ["l_returnflag"], "l_quantity", 0.0, 50.0, 10, density=True), 9)


@query("w1_sub_index", "SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS sub_index FROM events")
def _(t: Tables):
    return stats.sub_index(t.events, ["event_type"], ["ts", "event_id"]).select("event_id", "event_type", "sub_index")


@query("w2_normalized_quality", """
WITH m AS (SELECT event_type, median(value) FILTER (value > 0) AS m, count(*) FILTER (value > 0) AS n FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN n >= 2 THEN value / m END, 6) AS quality_norm FROM events JOIN m USING (event_type)
""")
def _(t: Tables):
    return stats.normalize_by_median(t.events, ["event_type"], "value").select("event_id", r("quality_norm").alias("quality_norm"))


@query("w3_percentile_rank", """
SELECT l_orderkey, l_linenumber, round((count(*) OVER (PARTITION BY l_returnflag ORDER BY l_quantity RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) / (count(*) OVER (PARTITION BY l_returnflag) - 1), 9) AS pct FROM lineitem
""")
def _(t: Tables):
    return stats.percentile_rank(t.lineitem, ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", r("pct", 9).alias("pct"))


def _clip_sql(rounds: int, sigma: float) -> str:
    """The clipped line as a chain of tables, a round each; done groups keep their mask."""
    q = ["WITH r0 AS (SELECT l_returnflag AS g, l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y, true AS inl, false AS done FROM lineitem)"]
    for i in range(rounds):
        q.append(f"f{i} AS MATERIALIZED (SELECT g, regr_slope(y, x) FILTER (inl) AS a, regr_intercept(y, x) FILTER (inl) AS b, count(*) FILTER (inl) AS n FROM r{i} GROUP BY g)")
        q.append(f"s{i} AS MATERIALIZED (SELECT g, stddev_pop(y - a * x - b) FILTER (inl) AS sd FROM r{i} JOIN f{i} USING (g) GROUP BY g)")
        q.append(f"m{i} AS MATERIALIZED (SELECT r{i}.*, a, b, n, sd, CASE WHEN done OR sd = 0 THEN inl ELSE abs(y - a * x - b) < {sigma} * sd END AS nw FROM r{i} JOIN f{i} USING (g) JOIN s{i} USING (g))")
        q.append(f"r{i + 1} AS MATERIALIZED (SELECT g, l_orderkey, l_linenumber, x, y, nw AS inl, done OR bool_and(nw = inl) OVER (PARTITION BY g) AS done FROM m{i})")
    last = rounds - 1
    return ", ".join(q) + f" SELECT g AS l_returnflag, round(any_value(a), 4) AS slope, round(any_value(b), 4) AS intercept, round(any_value(sd), 4) AS std, any_value(n) AS n FROM m{last} GROUP BY g"


@query("g14_clipped_line", _clip_sql(5, 1.5))
def _(t: Tables):
    fits, _rows = stats.clipped_line_fit(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice", 1.5, 5)
    return rounded(fits, 4)


@query("g14_clipped_line_grouped", _clip_sql(5, 1.5).replace("l_returnflag AS g", "l_returnflag || l_linestatus AS g").replace("g AS l_returnflag", "g AS kind"))
def _(t: Tables):
    return rounded(stats.clipped_line_fit_grouped(t.lineitem.withColumn("kind", F.concat("l_returnflag", "l_linestatus")), ["kind"], "l_quantity", "l_extendedprice", 1.5, 5), 4)


@query("g16_parabola", """
WITH p AS (SELECT l_linenumber AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT g, avg(x) AS mx FROM p GROUP BY g),
d AS (SELECT p.g, x - mx AS d, x, y, mx FROM p JOIN m USING (g)),
s AS (SELECT g, any_value(mx) AS mx, count(*)::DOUBLE AS n, sum(d) AS s1, sum(d*d) AS s2, sum(d*d*d) AS s3, sum(d*d*d*d) AS s4, sum(y) AS t0, sum(y*d) AS t1, sum(y*d*d) AS t2 FROM d GROUP BY g),
k AS (SELECT *, s4*(s2*n - s1*s1) - s3*(s3*n - s1*s2) + s2*(s3*s1 - s2*s2) AS det FROM s)
SELECT g AS l_linenumber, CAST(n AS BIGINT) AS n, round((t2*(s2*n - s1*s1) - s3*(t1*n - s1*t0) + s2*(t1*s1 - s2*t0)) / det, 4) AS a FROM k
""")
def _(t: Tables):
    return stats.parabola_fit(t.lineitem, ["l_linenumber"], "l_quantity", "l_extendedprice", ["l_orderkey"]).select("l_linenumber", "n", r("a", 4).alias("a"))


@query("g17_power_law", """
WITH x AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity > 0), e AS (SELECT unnest([0.5, 0.75, 1.0, 1.25]) AS b),
f AS (SELECT g, b, regr_slope(y, pow(x, b)) AS a, regr_intercept(y, pow(x, b)) AS c, count(*) AS n, regr_syy(y, pow(x, b)) - pow(regr_sxy(y, pow(x, b)), 2) / regr_sxx(y, pow(x, b)) AS sse FROM x, e GROUP BY 1, 2)
SELECT g AS l_returnflag, round(arg_min(a, sse), 3) AS a, CAST(arg_min(b, sse) AS DOUBLE) AS b, round(arg_min(c, sse), 3) AS c, arg_min(n, sse) AS n FROM f GROUP BY g
""")
def _(t: Tables):
    got = stats.power_law_fit(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice", [0.5, 0.75, 1.0, 1.25])
    return got.select("l_returnflag", r("a", 3).alias("a"), "b", r("c", 3).alias("c"), "n")


@query("g17_size_for_target", """
SELECT l_returnflag, CAST(u.target AS DOUBLE) AS target, CASE WHEN (u.target - i) / s > 0 THEN CAST(ceil((u.target - i) / s - 1e-9) AS BIGINT) END AS size
FROM (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY 1), (SELECT unnest([100000.0, 200000.0]) AS target) u
""")
def _(t: Tables):
    fit = stats.power_law_fit(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice", [1.0])
    return stats.size_for(fit, [100000.0, 200000.0]).select("l_returnflag", "target", F.col("size").cast("long").alias("size"))


@query("g21_plane_fit", """
WITH p AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount AS y, l_extendedprice AS z FROM lineitem),
s AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) * var_pop(x) AS xx, count(*) * var_pop(y) AS yy, count(*) * covar_pop(x, y) AS xy, count(*) * covar_pop(x, z) AS xz, count(*) * covar_pop(y, z) AS yz, median(z) AS med FROM p GROUP BY g)
SELECT g AS l_returnflag, n, round((xz * yy - yz * xy) / (xx * yy - xy * xy), 3) AS a, round((yz * xx - xz * xy) / (xx * yy - xy * xy), 2) AS b, round(med, 4) AS median FROM s
""")
def _(t: Tables):
    return stats.plane_fit(t.lineitem, ["l_returnflag"], "l_quantity", "l_discount", "l_extendedprice").select("l_returnflag", "n", r("a", 3).alias("a"), r("b", 2).alias("b"), r("median", 4).alias("median"))


def _ratio_sql(rounds: int) -> str:
    q = ["WITH r0 AS (SELECT l_returnflag AS g, ln(l_extendedprice / l_quantity) AS l, true AS inl FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0)"]
    for i in range(rounds):
        q.append(f"a{i} AS MATERIALIZED (SELECT g, median(l) FILTER (inl) AS m, stddev_pop(l) FILTER (inl) AS sd FROM r{i} GROUP BY g)")
        q.append(f"b{i} AS MATERIALIZED (SELECT g, median(abs(l - m)) FILTER (inl) AS mad FROM r{i} JOIN a{i} USING (g) GROUP BY g)")
        q.append(f"c{i} AS MATERIALIZED (SELECT r{i}.*, CASE WHEN CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END > 0 THEN abs(l - m) <= 2.0 * CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END ELSE inl END AS nw FROM r{i} JOIN a{i} USING (g) JOIN b{i} USING (g))")
        q.append(f"r{i + 1} AS MATERIALIZED (SELECT g, l, CASE WHEN count(*) FILTER (nw) OVER (PARTITION BY g) >= 3 THEN nw ELSE inl END AS inl FROM c{i})")
    q.append(f"z AS (SELECT g, median(l) AS m, count(*) AS used FROM r{rounds} WHERE inl GROUP BY g)")
    return ", ".join(q) + f" SELECT g AS l_returnflag, round(median(exp(l)), 4) AS ratio, round(median(abs(l - m)), 6) AS mad, any_value(used) AS used FROM r{rounds} JOIN z USING (g) WHERE inl GROUP BY g"


@query("g27_clipped_ratio", _ratio_sql(3))
def _(t: Tables):
    got = stats.clipped_ratio(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice", 2.0, 3, 3)
    return got.select("l_returnflag", r("ratio", 4).alias("ratio"), r("mad").alias("mad"), "used")


@query("g28_r_squared", """
SELECT l_returnflag, count(*) AS n, round(1 - sum(pow(l_extendedprice - 1500 * l_quantity, 2)) / (count(*) * var_pop(l_extendedprice)), 6) AS r2 FROM lineitem GROUP BY 1
""")
def _(t: Tables):
    return rounded(stats.r_squared(t.lineitem.withColumn("fitted", 1500 * F.col("l_quantity")), ["l_returnflag"], "l_extendedprice", "fitted"))


TRIMMED = """
WITH k AS (SELECT l_returnflag AS g, l_extendedprice AS r, l_quantity AS t, count(*) OVER (PARTITION BY l_returnflag) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber) AS k FROM lineitem),
f AS (SELECT g, count(*) AS used, any_value(n) AS n, regr_slope(r, t) AS s, regr_intercept(r, t) AS o, median(r) AS ref_bg, median(t) AS target_bg FROM k WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY g)
"""


@query("g30_trimmed_affine", TRIMMED + """
SELECT g AS l_returnflag, round(CASE WHEN s BETWEEN 100 AND 5000 THEN s ELSE 1 END, 4) AS scale, round(CASE WHEN s BETWEEN 100 AND 5000 THEN o ELSE ref_bg - target_bg END, 3) AS "offset", round(ref_bg, 4) AS ref_bg, round(target_bg, 4) AS target_bg, used, NOT s BETWEEN 100 AND 5000 AS clamped FROM f WHERE n >= 2000 AND used >= 1000
""")
def _(t: Tables):
    got = stats.trimmed_affine(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber"], low=100, high=5000)
    return got.withColumns({"scale": r("scale", 4), "offset": r("offset", 3), "ref_bg": r("ref_bg", 4), "target_bg": r("target_bg", 4)})


@query("g30_clamped_affine", TRIMMED + """
SELECT g AS l_returnflag, 1.0::DOUBLE AS scale, round(ref_bg - target_bg, 4) AS "offset", used, true AS clamped FROM f WHERE n >= 2000 AND used >= 1000
""")
def _(t: Tables):
    got = stats.trimmed_affine(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber"])
    return rounded(got.select("l_returnflag", "scale", "offset", "used", "clamped"), 4)


@query("g31_additive_offset", TRIMMED + """
SELECT g AS l_returnflag, 1.5::DOUBLE AS scale, round(ref_bg - 1.5 * target_bg, 4) AS "offset", used FROM f WHERE n >= 2000 AND used >= 1000
""")
def _(t: Tables):
    fit = stats.trimmed_affine(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber"])
    return rounded(stats.additive_offset(fit, 1.5).select("l_returnflag", "scale", "offset", "used"), 4)


FEATURES = """f AS (SELECT p_partkey AS id, p_size::DOUBLE AS s, p_retailprice - 1500 AS f, p_retailprice AS b, 1 + p_partkey % 7 AS n FROM part)"""


def _features(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("s"), (F.col("p_retailprice") - 1500).alias("f"), F.col("p_retailprice").alias("b"), (1 + F.col("p_partkey") % 7).cast("double").alias("n"))


@query("p20_p23_metric_scores", f"""
WITH {FEATURES} SELECT id, round(s / n, 6) AS star_yield, round(f / n, 6) AS stellar_contrast, round(CASE WHEN f > 0 THEN ln(1 + s) * f / (n * sqrt(b)) END, 6) AS sky_weighted_contrast,
round(pow(s, 0.75) * sign(f) * pow(abs(f), 0.75) / (sqrt(n) * pow(b, 0.25)), 6) AS stellar_quality FROM f
""")
def _(t: Tables):
    return rounded(quality.metric_scores(_features(t), "s", "f", "b", "n").select("id", *quality.METRICS))


@query("p24_formula_sweep", f"""
WITH {FEATURES}, st AS (SELECT unnest([0, 1, 2, 3, 4]) AS si), fe AS (SELECT unnest([0.75, 1.0, 1.25])::DOUBLE AS fx, unnest([0, 1, 2]) AS fi), ne AS (SELECT unnest([0.5, 1.0, 1.5])::DOUBLE AS nx, unnest([0, 1, 2]) AS ni), be AS (SELECT unnest([0.25, 0.5, 1.0])::DOUBLE AS bx, unnest([0, 1, 2]) AS bi)
SELECT id, CAST(si * 27 + fi * 9 + ni * 3 + bi AS INTEGER) AS formula, round(CASE WHEN si = 4 THEN ln(1 + s) ELSE pow(s, si * 0.25::DOUBLE) END * sign(f) * pow(abs(f), fx) / (pow(n, nx) * pow(b, bx)), 4) AS score FROM f, st, fe, ne, be
""")
def _(t: Tables):
    return rounded(quality.formula_sweep(_features(t), "id", "s", "f", "b", "n"), 4)


LABELS = """
l AS (SELECT event_id AS left_path, lead(event_id) OVER w AS right_path, value AS lv, lead(value) OVER w AS rv, user_id % 10 AS k, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS ls,
      CASE WHEN (lead(event_id) OVER w) % 13 = 0 THEN NULL ELSE lead(value) OVER w END AS rs FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
j AS (SELECT *, CASE WHEN k = 0 THEN 'reject' WHEN k = 1 THEN 'tie' WHEN k < 6 THEN 'left' ELSE 'right' END AS winner FROM l WHERE right_path IS NOT NULL),
o AS (SELECT *, CASE WHEN winner IN ('reject', 'tie') THEN CASE winner WHEN 'reject' THEN 'rejected' ELSE 'tie' END WHEN ls IS NULL OR rs IS NULL THEN 'skipped' WHEN (winner = 'left' AND ls - rs > 0.1) OR (winner = 'right' AND ls - rs < -0.1) THEN 'correct' ELSE 'violation' END AS outcome,
      CASE WHEN winner = 'left' THEN greatest(0.1 - (ls - rs), 0) ELSE greatest(ls - rs + 0.1, 0) END AS sev FROM j)
"""


def _judged(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("event_id")
    e = t.events.select("event_type", "user_id", F.col("event_id").alias("left_path"), F.lead("event_id").over(w).alias("right_path")).where("right_path is not null")
    k = F.col("user_id") % 10
    labels = e.withColumn("winner", F.when(k == 0, "reject").when(k == 1, "tie").when(k < 6, "left").otherwise("right"))
    scores = t.events.select(F.col("event_id").alias("path"), F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("score"))
    return quality.judged_pairs(quality.with_scores(labels, scores, "path", "score"), 0.1)


@query("g46_pairwise_evaluation", f"""WITH {LABELS}
SELECT count(*) FILTER (outcome IN ('correct', 'violation')) AS total, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'skipped') AS skipped,
count(*) FILTER (outcome = 'violation') AS violations, round(sum(sev) FILTER (outcome = 'violation'), 3) AS severity, round(count(*) FILTER (outcome = 'correct') / count(*) FILTER (outcome IN ('correct', 'violation')), 6) AS accuracy FROM o
""")
def _(t: Tables):
    return quality.evaluation(_judged(t), []).withColumn("severity", r("severity", 3)).withColumn("accuracy", r("accuracy"))


@query("o3_worst_violations", f"WITH {LABELS} SELECT left_path, right_path, round(sev, 6) AS severity FROM o WHERE outcome = 'violation' ORDER BY sev DESC, left_path, right_path LIMIT 20")
def _(t: Tables):
    return quality.worst_violations(_judged(t), 20).select("left_path", "right_path", r("severity").alias("severity"))


@query("o2_metric_ranking", """
WITH e AS (SELECT event_type AS name, count(*) FILTER (value > 50) AS c, count(*) AS n, sum(value) AS s FROM events GROUP BY 1)
SELECT name, round(c / n, 9) AS accuracy, n - c AS violations, round(s, 3) AS severity FROM e ORDER BY c / n DESC, n - c, s, name LIMIT 3
""")
def _(t: Tables):
    e = t.events.groupBy(F.col("event_type").alias("name")).agg((F.count_if(F.col("value") > 50) / F.count("*")).alias("accuracy"), (F.count("*") - F.count_if(F.col("value") > 50)).alias("violations"), F.sum("value").alias("severity"))
    return quality.rank_metrics(e, "name", 3).select("name", r("accuracy", 9).alias("accuracy"), "violations", r("severity", 3).alias("severity"))


@query("u2_clear_paths", f"WITH {LABELS} SELECT DISTINCT path FROM (SELECT left_path AS path FROM o WHERE winner IN ('left', 'right') UNION ALL SELECT right_path FROM o WHERE winner IN ('left', 'right'))")
def _(t: Tables):
    return quality.clear_paths(_judged(t))


@query("o8_label_page", f"WITH {LABELS} SELECT left_path, right_path, CAST(row_number() OVER (ORDER BY left_path) AS INTEGER) AS row FROM o WHERE winner IN ('left', 'tie') QUALIFY row BETWEEN 21 AND 50")
def _(t: Tables):
    return quality.label_page(_judged(t), ["left_path"], ["left", "tie"], 21, 30).select("left_path", "right_path", "row")


@query("o1_best_and_worst", """
SELECT p_brand, p_partkey, 'best' AS side, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM part QUALIFY place <= 3
UNION ALL SELECT p_brand, p_partkey, 'worst', CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS INTEGER) AS place FROM part QUALIFY place <= 3
""")
def _(t: Tables):
    return quality.best_and_worst(t.part, ["p_brand"], "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "side", "place")


ROLES = """
x AS (SELECT p_brand, p_partkey AS path, p_retailprice AS score, 1.0 * (p_partkey % 17) AS bg, 1.0 * (p_partkey % 11) AS nz, p_size AS st, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS d, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS u,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 11 DESC, p_partkey DESC) AS mn, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 17 DESC, p_partkey DESC) AS mb, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS ms, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS xs FROM part),
y AS (SELECT p_brand, path, list_filter([CASE WHEN d = 1 THEN 'reference_rank_1' END, CASE WHEN d = 2 THEN 'reference_rank_2' END, CASE WHEN d = 3 THEN 'reference_rank_3' END, CASE WHEN u = 1 + round_even(0.5 * (n - 1), 0) THEN 'score_median' END, CASE WHEN u = 1 + round_even(0.1 * (n - 1), 0) THEN 'score_p10' END,
  CASE WHEN u = 1 + round_even(0.25 * (n - 1), 0) THEN 'score_p25' END, CASE WHEN u = 1 + round_even(0.75 * (n - 1), 0) THEN 'score_p75' END, CASE WHEN mn = 1 THEN 'max_bgnoise' END, CASE WHEN mb = 1 THEN 'max_background' END, CASE WHEN ms = 1 THEN 'min_star_count' END, CASE WHEN xs = 1 THEN 'max_star_count' END], lambda z: z IS NOT NULL) AS roles FROM x)
"""


def _roles(t: Tables):
    p = t.part.withColumn("bg", F.col("p_partkey") % 17).withColumn("nz", F.col("p_partkey") % 11)
    return quality.select_roles(p, ["p_brand"], "p_partkey", "p_retailprice", "nz", "bg", "p_size")


@query("w6_role_selection", f"WITH {ROLES} SELECT p_brand, path AS p_partkey, array_to_string(roles, ',') AS roles, roles[1] AS primary_role FROM y WHERE len(roles) > 0")
def _(t: Tables):
    return _roles(t).select("p_brand", "p_partkey", F.array_join("roles", ",").alias("roles"), "primary_role")


@query("w8_smoke_subset", f"""WITH {ROLES}, w AS (SELECT * FROM (VALUES (1, 'reference_rank_1'), (2, 'score_median'), (3, 'min_star_count')) v(i, role)),
f AS (SELECT p_brand, min(path) AS path, i FROM y JOIN w ON list_contains(roles, role) GROUP BY p_brand, i), c AS (SELECT y.p_brand, y.path, min(f.i) AS i FROM y LEFT JOIN f ON f.p_brand = y.p_brand AND f.path = y.path WHERE len(roles) > 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY i NULLS LAST, path) AS place FROM c)
SELECT p_brand, path AS p_partkey, CAST(place AS INTEGER) AS place FROM k WHERE place <= 6 OR i IS NOT NULL
""")
def _(t: Tables):
    return quality.smoke_subset(_roles(t), ["p_brand"], "p_partkey", ["reference_rank_1", "score_median", "min_star_count"])


PCT = {"score": "a", "stars": "b", "flux": "c", "background": "d", "gradient": "e", "r2": "f", "patchiness": "g", "range": "h"}


@query("w7_blended_roles", """
WITH x AS (SELECT l_suppkey AS g, l_orderkey * 10 + l_linenumber AS path, l_quantity / 50 AS a, (l_partkey % 101) / 100 AS b, (l_orderkey % 53) / 52 AS c, l_discount * 10 AS d, l_tax * 12 AS e, (l_partkey % 37) / 36 AS f, (l_orderkey % 71) / 70 AS g2, (l_suppkey + l_orderkey) % 29 / 28 AS h FROM lineitem),
z AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM x WHERE a >= 0.45 AND path % 11 <> 0), y AS (SELECT *, 0.55 * a + 0.30 * (1 - greatest(coalesce(nullif(h, 0), 0.5), coalesce(nullif(e, 0), 0.5), coalesce(nullif(g2, 0), 0.5))) + 0.10 * a + 0.05 * b AS rs FROM z WHERE n >= 3), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(rs, 9) DESC, path DESC) AS k FROM y),
t AS (SELECT g, path, unnest(['illum_gradient_high', 'illum_patchy_high', 'illum_range_high', 'bright_gradient', 'cloud_suspect']) AS role, unnest([(e + f) / 2, g2, h, 0.5 * d + 0.5 * e, 0.55 * g2 + 0.225 * (1 - coalesce(nullif(b, 0), 0.5)) + 0.225 * (1 - coalesce(nullif(c, 0), 0.5))]) AS s FROM k WHERE k > 2),
m AS (SELECT g, role, path, s, row_number() OVER (PARTITION BY g, role ORDER BY round(s, 9) DESC, path DESC) AS k FROM t)
SELECT g AS l_suppkey, path, 'illum_reference_rank_' || k AS role, round(rs, 6) AS strength FROM k WHERE k <= 2 UNION ALL SELECT g, path, role, round(s, 6) FROM m WHERE k = 1
""")
def _(t: Tables):
    x = t.lineitem.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path"), (F.col("l_quantity") / 50).alias("a"), ((F.col("l_partkey") % 101) / 100).alias("b"), ((F.col("l_orderkey") % 53) / 52).alias("c"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 12).alias("e"), ((F.col("l_partkey") % 37) / 36).alias("f"), ((F.col("l_orderkey") % 71) / 70).alias("g"), ((F.col("l_suppkey") + F.col("l_orderkey")) % 29 / 28).alias("h"))
    return quality.blended_roles(x, ["l_suppkey"], "path", PCT, "a", usable=quality.usable_illumination(F.when(F.col("path") % 11 != 0, "success"), F.col("a"), F.col("a"))).withColumn("strength", r("strength"))


@query("g47_runtime_rollup", f"""
WITH x AS (SELECT o_orderpriority, o_totalprice AS x FROM orders) SELECT o_orderpriority, count(*) AS n, {NEAREST.format(q=0.9)} AS p90, round(median(x), 6) AS median, round(median(x) * 15476 / 3600, 4) AS projected_hours FROM x GROUP BY 1
""")
def _(t: Tables):
    got = quality.runtime_rollup(t.orders, ["o_orderpriority"], "o_totalprice", 15476)
    return got.withColumn("median", r("median")).withColumn("projected_hours", r("projected_hours", 4))


@query("g48_ab_summary", """
WITH s AS (SELECT l_partkey, min(l_extendedprice) FILTER (l_linestatus = 'F') AS f, min(l_extendedprice) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1), c AS (SELECT * FROM s WHERE f IS NOT NULL AND o IS NOT NULL)
SELECT count(*) AS pairs, count(*) FILTER (f < o) AS "wins_F", count(*) FILTER (o < f) AS "wins_O", median(f) AS "median_F", median(o) AS "median_O" FROM c
""")
def _(t: Tables):
    runs = t.lineitem.groupBy("l_partkey", "l_linestatus").agg(F.min("l_extendedprice").alias("v"))
    return quality.ab_summary(runs, ["l_partkey"], "l_linestatus", "v", ["F", "O"])


@query("g15_focus_model", """
WITH """ + _clip_sql(10, 3.0).removeprefix("WITH ").rsplit(" SELECT ", 1)[0] + """,
g AS (SELECT g, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_r2(y, x) AS r2, count(*) AS n FROM r10 WHERE inl GROUP BY g)
SELECT g AS l_returnflag, round_even(s, 2) AS slope, round_even(i, 1) AS intercept, round_even(r2, 4) AS r2, n, round_even(i - (SELECT i FROM g WHERE g = 'N'), 1) AS "offset" FROM g
""")
def _(t: Tables):
    return logs.focus_model(t.lineitem, "l_returnflag", "l_quantity", "l_extendedprice", "N")
