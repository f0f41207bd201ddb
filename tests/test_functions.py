"""Scalar functions and statistics on small cases."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from noctua.functions import scalar as S
from noctua.operators import joins, lnc, measures, planning, quality, sessions, stats, tiles
from noctua.session import written


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_header_lookup_tries_keys_then_aliases(spark):
    hdr = F.create_map(*[F.lit(x) for x in ("Exp Time", "12.5", "GAIN", "abc", "CCD:Gain", "100")])
    r = one(spark, a=S.header_value(hdr, "EXPTIME"), b=S.first_number(hdr, "GAIN", "CCD:Gain"), c=S.header_value(hdr, "NONE"), d=S.first_number(hdr, "NONE", default=3.0))
    assert (r.a, r.b, r.c, r.d) == ("12.5", 100.0, None, 3.0)


@pytest.mark.parametrize(("raw", "want"), [("H-alpha", "H"), (" oiii ", "O"), ("Clear 2", "Clear_2"), ("", None), (None, None), ("Ha5", "Ha5")])
def test_canonical_filter(spark, raw, want):
    assert one(spark, f=S.canonical_filter(F.lit(raw).cast("string"))).f == want


def test_dates_in_all_forms(spark):
    forms = ["2026-02-03T04:05:06", "2026-02-03T04:05:06.25", "2026-02-03T06:05:06+02:00", "2026-02-03 04:05:06", "2026/02/03 04:05:06", "nonsense"]
    got = [r.t for r in spark.createDataFrame([(f,) for f in forms], "s string").select(S.parse_date_obs(F.col("s")).alias("t")).collect()]
    want = dt.datetime(2026, 2, 3, 4, 5, 6)
    assert got[0] == got[2] == got[3] == got[4] == want and got[1] == want.replace(microsecond=250000) and got[5] is None


def test_sexagesimal_keeps_the_sign_of_minus_zero(spark):
    r = one(spark, a=S.sexagesimal(F.lit("-00 30 00")), b=S.sexagesimal(F.lit("05:30:36")), c=S.sexagesimal(F.lit("x")), d=S.sexagesimal_text(F.lit(-0.5)))
    assert (r.a, round(r.b, 9), r.c, r.d) == (-0.5, 5.51, None, "-00 30 00.0")


def test_unquote_and_finite(spark):
    r = one(spark, a=S.unquote(F.lit(" 'O''Brien' ")), b=S.finite(F.lit("NaN")), c=S.finite(F.lit("1.5")), d=S.finite(F.lit(float("inf"))))
    assert (r.a, r.b, r.c, r.d) == ("O'Brien", None, 1.5, None)


def test_message_text_and_roof_state(spark):
    rows = [("", [Row(title="Roof", description="is opening", fields=[Row(name="a", value="b")], footer=None, author="me")]), ("roof closed", None)]
    schema = "content string, embeds array<struct<title:string,description:string,fields:array<struct<name:string,value:string>>,footer:string,author:string>>"
    got = spark.createDataFrame(rows, schema).select(S.message_text(F.col("content"), F.col("embeds")).alias("t")).withColumn("s", S.roof_state(F.col("t"))).collect()
    assert got[0].t == "Roof\nis opening\na\nb\nme" and [g.s for g in got] == ["OPEN", "CLOSED"]


def test_metric_scores_of_known_features(spark):
    d = spark.createDataFrame([(99.0, 10.0, 100.0, 2.0), (50.0, -4.0, 1.0, 2.5), (5.0, 1.0, 1.0, 0.0)], "s double, f double, b double, n double")
    got = quality.metric_scores(d, "s", "f", "b", "n").collect()
    assert got[0].sky_weighted_contrast == pytest.approx(math.log1p(99) * 10 / 20)
    assert got[1].star_yield == 20 and got[1].stellar_quality < 0 and got[1].sky_weighted_contrast is None
    assert got[2].star_yield is None and got[2].stellar_quality is None


def test_formula_sweep_has_135_formulas_and_the_known_score(spark):
    d = spark.createDataFrame([("a", 16.0, 8.0, 4.0, 2.0)], "k string, s double, f double, b double, n double")
    got = quality.formula_sweep(d, "k", "s", "f", "b", "n")
    assert got.count() == 135
    at = 2 * 27 + 1 * 9 + 1 * 3 + 1  # star^0.5, flux^1, noise^1, background^0.5
    assert got.where(F.col("formula") == at).first().score == pytest.approx(8.0)


def test_median_mad(spark):
    d = spark.createDataFrame([(v,) for v in (10.0, 11.0, 12.0, 1000.0, float("nan"), None)], "v double").withColumn("g", F.lit(1))
    r = stats.median_mad(d, ["g"], "v").first()
    assert (r.n, r.median, r.mad, r.sigma) == (4, 11.5, 1.0, 1.4826)


def test_normalization_by_median(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,)], "v double").withColumn("g", F.lit(1))
    assert sorted((r.quality_norm for r in stats.normalize_by_median(d, ["g"], "v").collect()), key=str) == [0.5, 1.0, 2.0, None]


def test_clipped_ratio_of_scaled_fluxes(spark):
    a = [100.0, 200.0, 300.0, 400.0, 500.0, 600.0]
    b = [x * 1.2 for x in a[:5]] + [5000.0]
    r = stats.clipped_ratio(spark.createDataFrame(zip(a, b), "a double, b double").withColumn("g", F.lit(1)), ["g"], "a", "b", 2.0, 4).first()
    assert r.ratio == pytest.approx(1.2) and r.used == 5


def test_clipped_line_agrees_with_the_grouped_form_and_stops_at_a_perfect_fit(spark):
    rows = [(g, float(x), 2.0 * x + 1 + (50 if x == 7 and g == "a" else 0) + (0.1 * (-1) ** x if g == "b" else 0)) for g in "ab" for x in range(20)]
    d = spark.createDataFrame(rows, "g string, x double, y double")
    fits = {r.g: r for r in stats.clipped_line_fit(d, ["g"], "x", "y")[0].collect()}
    for r in stats.clipped_line_fit_grouped(d, ["g"], "x", "y").collect():
        assert (r.slope, r.intercept, r.n) == (pytest.approx(fits[r.g].slope), pytest.approx(fits[r.g].intercept, abs=1e-6), fits[r.g].n)
    assert fits["a"].slope == pytest.approx(2.0) and fits["a"].n == 19


def test_parabola_vertex_and_monotonic_series(spark):
    rows = [("v", float(x), (x - 5.0) ** 2 + 3) for x in range(11)] + [("m", float(x), float(x)) for x in range(5)]
    got = {r.g: r for r in stats.parabola_fit(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", ["x"]).collect()}
    assert got["v"].best == pytest.approx(5.0) and got["v"].r2 == pytest.approx(1.0) and not got["v"].monotonic
    assert got["m"].monotonic and got["m"].best == 0.0


def test_power_law_and_size(spark):
    d = spark.createDataFrame([(float(n), 0.25 * n**0.5 + 0.1) for n in (2, 4, 8, 16, 32, 64)], "n double, snr double").withColumn("g", F.lit(1))
    fit = stats.power_law_fit(d, ["g"], "n", "snr", [0.4, 0.5, 0.6])
    assert fit.first().b == 0.5 and stats.size_for(fit, [2.6]).first().size == 100


def test_drop_policy_restores_and_never_drops_the_reference(spark):
    d = spark.createDataFrame([("g", f"p{i}", s) for i, s in enumerate([10.0, 9.5, 9.0, 1.0, 0.5])] + [("few", "a", 1.0), ("few", "b", None)], "g string, path string, score double")
    got = {(r.g, r.path): r for r in quality.drop_policy(d, ["g"], "score", "path", 3, 0.15).collect()}
    assert got["g", "p0"].drop_status == "reference" and got["g", "p0"].sequence_index == 1
    assert sum(r.drop_status == "dropped_quality_outlier" for r in got.values()) <= 1
    assert got["few", "a"].drop_status == "too_few_valid_scores" and got["few", "b"].drop_status == "skipped_invalid_score"


def test_pairwise_evaluation(spark):
    scores = dict(zip("abcdefghij", [2.0, 1.0, 4.0, 3.0, 0.0, 0.0, 0.0, 0.0, 1.0, 3.0], strict=True)) | {"d": 5.0}
    labels = [("a", "b", "left"), ("c", "d", "right"), ("e", "f", "tie"), ("g", "h", "reject"), ("i", "j", "left")]
    got = quality.with_scores(spark.createDataFrame(labels, "left_path string, right_path string, winner string"), spark.createDataFrame(list(scores.items()), "path string, score double"), "path", "score")
    r = quality.evaluation(quality.judged_pairs(got, 0.1), []).first()
    assert (r.total, r.correct, r.rejected, r.skipped, r.violations) == (3, 2, 1, 0, 1) and r.accuracy == pytest.approx(2 / 3)


def test_sessions_take_other_columns_from_the_first_frame(spark):
    d = spark.createDataFrame([("d", "R", "b", 9.0), ("d", "R", "a", -9.7)], "date string, filter string, path string, temp double")
    r = sessions.sessions(d, ["date", "filter"], "path", {"cooling": sessions.sensor_cooling(F.col("temp"))}).first()
    assert (r.number, r.cooling) == (2, -9)


def test_cross_match_is_one_to_one(spark):
    ref = spark.createDataFrame([("f", 1, 0.0, 0.0), ("f", 2, 10.0, 0.0)], "f string, id int, x double, y double")
    tgt = spark.createDataFrame([("f", 1, 0.5, 0.0), ("f", 2, 0.2, 0.0), ("f", 3, 11.0, 0.0), ("f", 4, 50.0, 0.0)], "f string, id int, x double, y double")
    assert sorted((r.target_id, r.reference_id) for r in joins.cross_match(tgt, ref, ["f"], 2.0).collect()) == [(2, 1), (3, 2)]


def test_dark_matches(spark):
    darks = spark.createDataFrame([(5, 56, 20, 480, -10, "d1"), (5, 56, 20, 480, 0, "d2")], "mode int, gain int, offset int, exptime int, temp int, path string")
    frames = spark.createDataFrame([(1, None, 56.9, None, None, None), (2, 5.0, 56.0, 20.0, 480.0, 0.4)], "id int, mode double, gain double, offset double, exptime double, temp double")
    assert {r.id: r.dark_path for r in joins.match_dark_exact(frames, darks).collect()} == {1: "d1", 2: "d2"}


def test_required_groups(spark):
    rows, want = spark.createDataFrame([("a", 1)], "g string, v int"), spark.createDataFrame([("a",), ("b",)], "g string")
    with pytest.raises(ValueError, match="b"):
        joins.require_groups(rows, want, ["g"])


def test_inverse_times_matrix_is_identity(spark):
    m = F.array(*[F.lit(v) for v in (1.0, 0.2, 4.0, 0.1, 1.1, -3.0, 0.0, 0.001, 1.0)])
    got = spark.range(1).withColumn("m", m).withColumn("i", lnc.inverse(F.col("m"))).select(lnc.product(F.col("i"), F.col("m")).alias("p"), lnc.inverse(F.array(*[F.lit(0.0)] * 9)).alias("s")).first()
    assert got.p == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1], abs=1e-12) and got.s is None


def test_normalization_recovers_scale_and_offset(spark):
    """A ramp with a wave; the target is (reference + 73) / 1.18, turned and shifted; the residual after is below 2 percent of before."""
    n, m = 48, np.array([[1.0, 0.02, 1.5], [-0.02, 1.0, 2.0], [0.0, 0.0, 1.0]])
    sky = lambda y, x: 500.0 + 3 * x + 2 * y + 20 * np.sin(x / 5)
    y, x = np.mgrid[:n, :n].astype(float)
    back = np.linalg.inv(m)
    ref, tgt = sky(y, x), (sky(*(back[i, 0] * x + back[i, 1] * y + back[i, 2] for i in (1, 0))) + 73) / 1.18
    cut = lambda name, image: spark.createDataFrame([(name, *[t[c] for c in ("ty", "tx", "y0", "x0", "h", "w")], t["px"].tolist()) for t in tiles.cut_tiles(image, 16)], tiles.TILE)
    pairs = spark.createDataFrame([("p", "r", "t", m.ravel().tolist())], "pair_id string, reference_id string, target_id string, m array<double>")
    got = lnc.normalized(cut("r", ref), cut("t", tgt), pairs, 16, 24, 16, min_samples=100)
    fixed = np.zeros((n, n))
    for t in got.collect():
        fixed[t.y0 : t.y0 + t.h, t.x0 : t.x0 + t.w] = np.reshape(t.px, (t.h, t.w))
    want = tgt * 1.18 - 73
    assert np.abs(fixed - want).sum() < 0.02 * np.abs(tgt - want).sum()


def _sampled(ref, target, mask, m, step, radius):
    """Sums by node of samples read pixel by pixel."""
    out = {}
    for y in range(ref.shape[0]):
        for x in range(ref.shape[1]):
            w = m[6] * x + m[7] * y + m[8]
            if abs(w) <= 1e-12 or not np.isfinite(ref[y, x]):
                continue
            tx, ty = (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w
            if not (0 <= tx <= target.shape[1] - 1 and 0 <= ty <= target.shape[0] - 1) or mask[int(ty + 0.5), int(tx + 0.5)]:
                continue
            x0, y0 = int(tx), int(ty)
            x1, y1 = min(x0 + 1, target.shape[1] - 1), min(y0 + 1, target.shape[0] - 1)
            four = [target[y0, x0], target[y0, x1], target[y1, x0], target[y1, x1]]
            if not np.isfinite(four).all():
                continue
            v = (1 - ty + y0) * ((1 - tx + x0) * four[0] + (tx - x0) * four[1]) + (ty - y0) * ((1 - tx + x0) * four[2] + (tx - x0) * four[3])
            for gy in range((ref.shape[0] - 1) // step + 1):
                for gx in range((ref.shape[1] - 1) // step + 1):
                    if (y - gy * step) ** 2 + (x - gx * step) ** 2 <= radius**2:
                        n, a, b = out.get((gy, gx), (0, 0.0, 0.0))
                        out[gy, gx] = n + 1, a + ref[y, x], b + v
    return out


@pytest.mark.parametrize("m", [[1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0], [0.7, 0.7, -4.0, -0.7, 0.7, 12.0, 0.001, -0.002, 1.0], [1.0, 0, 5, 0, 1.0, 0, -0.05, 0, 1.0], [1.0, 0, 500, 0, 1.0, 0, 0, 0, 1.0]])
def test_paired_samples_as_pixel_by_pixel(spark, m):
    rng = np.random.default_rng(5)
    ref, target, mask = rng.random((21, 26)).astype(np.float32), rng.random((24, 19)).astype(np.float32), rng.random((24, 19)) < 0.1
    ref[rng.random(ref.shape) < 0.05] = np.nan
    target[rng.random(target.shape) < 0.02] = np.inf
    rows = lambda name, image: [(name, *[t[c] for c in ("ty", "tx", "y0", "x0", "h", "w")], t["px"].tolist(), None) for t in tiles.cut_tiles(image, 8)]
    masked = [(*t[:8], mask[t[3] : t[3] + t[5], t[4] : t[4] + t[6]].ravel().tolist()) for t in rows("t", target)]
    kinds = tiles.TILE + ", mask array<boolean>"
    pairs = spark.createDataFrame([("p", "r", "t", [float(v) for v in m]), ("q", "r", "none", [1.0] * 9)], "pair_id string, reference_id string, target_id string, m array<double>")
    got = lnc.paired_samples(spark.createDataFrame(rows("r", ref), kinds).drop("mask"), spark.createDataFrame(masked, kinds), pairs, 6, 11, 8).collect()
    sums = {}
    for s in got:
        n, a, b = sums.get((s.gy, s.gx), (0, 0.0, 0.0))
        sums[s.gy, s.gx] = n + len(s.ref), a + sum(s.ref), b + sum(s.target)
    want = _sampled(ref.astype(float), target.astype(float), mask, m, 6, 5)
    assert sums.keys() == want.keys() and all(sums[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_lookups_outside_and_without_any_node():
    valid = np.zeros((3, 3), bool)
    y, x = np.array([0.0, 3.0, 9.0, -5.0]), np.array([0.0, 3.5, 9.0, 2.0])
    s, o = lnc.grid_at(np.full((3, 3), 7.0), np.full((3, 3), 5.0), valid, y, x, 2, (6, 6))
    assert s.tolist() == [1.0] * 4 and o.tolist() == [0.0] * 4
    valid[1, 1] = True
    s, o = lnc.grid_at(np.full((3, 3), 7.0), np.full((3, 3), 5.0), valid, y, x, 2, (6, 6))
    assert s == pytest.approx([7.0] * 4) and o == pytest.approx([5.0] * 4)


def test_holes_are_filled_from_neighbours(spark):
    rows = [("p", y, x, 2.0, 1.0, 0.0, 0.0, not (y == 1 and x == 1)) for y in range(3) for x in range(3)]
    grid = spark.createDataFrame([(*r[:3], *((None,) * 4 if not r[7] else r[3:7]), r[7]) for r in rows], lnc.GRID)
    got = lnc.fill_and_smooth(grid, 1).where("gy = 1 and gx = 1").first()
    assert (got.scale, got.offset, got.valid) == (2.0, 1.0, True)


def test_star_flux_and_orientation(spark):
    px = [10.0] * 49
    px[1 * 7 + 1], px[5 * 7 + 5] = 14.0, 18.0
    t = spark.createDataFrame([("f", 0, 0, 0, 0, 7, 7, px)], tiles.TILE)
    stars = spark.createDataFrame([("f", 1, 1.0, 1.0, 1.0, 10.0), ("f", 2, 5.0, 5.0, 1.0, 10.0)], "frame_id string, star_id int, x double, y double, fwhm double, bg double")
    assert tiles.mean_star_flux(t, stars, 7, 7, "bg", scale=0.1).first().median_mean_star_flux == 6.0
    px = [0.0] * 49
    px[6 * 7 + 3] = 100.0
    t = spark.createDataFrame([("f", 0, 0, 0, 0, 7, 7, px)], tiles.TILE)
    star = spark.createDataFrame([("f", 1, 3.0, 0.0, 1.0, 10.0)], stars.schema)
    assert tiles.mean_star_flux(t, star, 7, 7, "bg", scale=0.1).first().median_mean_star_flux == 90.0


def test_aperture_photometry_flags_and_flux(spark):
    px = [10.0] * 400
    px[10 * 20 + 10] = 110.0
    t = spark.createDataFrame([("f", 0, 0, 0, 0, 20, 20, px)], tiles.TILE)
    stars = spark.createDataFrame([("f", 1, 10.0, 10.0), ("f", 2, 0.0, 0.0)], "frame_id string, star_id int, x double, y double")
    got = {r.star_id: r for r in tiles.aperture_photometry(t, stars, 20, 20, 20, 2.0, 4.0, 6.0, 100.0).collect()}
    assert got[1].flux is None and got[1].peak == 110 and got[1].flags == ["saturated"]
    assert got[2].flags == ["edge"] and got[2].peak is None and got[2].background is None
    got = {r.star_id: r for r in tiles.aperture_photometry(t, stars, 20, 20, 20, 2.0, 4.0, 6.0, 1000.0).collect()}
    assert got[1].flux == 100.0 and got[1].background == 10 and got[1].snr == float("inf") and got[1].flags == []


def test_hours_to_the_flip(spark):
    """The pier on the east: 12 hours and the angle less the hour angle; else what is left to the angle, 0 beyond it."""
    got = one(spark, **{f"h{i}": S.hours_to_flip(F.lit(float(ra)), F.lit(float(lst)), F.lit(east), 0.5) for i, (ra, lst, east) in enumerate([(5, 3, False), (5, 7, False), (5, 7, True), (1, 23, False), (1, 23, True)])})
    assert [got[f"h{i}"] for i in range(5)] == [2.5, 0.0, 10.5, 2.5, 14.5]


def test_stretch_of_the_log_and_stars_without_a_score(spark):
    got = one(spark, a=S.log_stretch(F.lit(0.001), F.lit(0.0), F.lit(1.0)), b=S.stellar_quality(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert abs(got.a - 0.1003) < 1e-4 and got.b is None


def test_thin_nodes_are_left_out(spark):
    d = spark.range(1500).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), (2 * F.col("id") + 1.0).alias("r"), "id")
    assert stats.trimmed_affine(d, ["k"], "r", "t", ["id"]).count() == 0
    got = stats.trimmed_affine(d, ["k"], "r", "t", ["id"], min_samples=1500).first()
    assert abs(got.scale - 2) < 1e-9 and got.used == 1200 and not got.clamped


def test_sun_and_moon_at_known_times(spark):
    """March equinox 2024 (declination 0) and the full moon of 2024-01-25 17:54 UTC."""
    r = one(spark, dec=planning.sun(F.to_timestamp(F.lit("2024-03-20 03:06:00")))[1], full=planning.moon_illumination(F.to_timestamp(F.lit("2024-01-25 17:54:00"))), new=planning.moon_illumination(F.to_timestamp(F.lit("2024-02-09 22:59:00"))))
    assert abs(r.dec) < 0.02 and r.full > 99.5 and r.new < 0.5


def test_degree_two_surface(spark):
    rows = [("f", x / 7, y / 7, 5 + x / 7 + 2 * y / 7 + 3 * (x / 7) ** 2) for x in range(8) for y in range(8)]
    got = lnc.subtract_surface(spark.createDataFrame(rows, "k string, x double, y double, background double"), ["k"])
    assert got.agg(F.max(F.abs("residual"))).first()[0] < 1e-8


def test_masks_cover_what_a_loop_over_pixels_covers(spark):
    from noctua.operators import masks

    rows = [("a", 3.0, 4.0, 1.0), ("a", 11.5, 0.25, None), ("a", 11.0, 8.0, -1.0), ("b", -2.0, 5.0, 1.5), ("b", None, 5.0, 1.5)]
    stars = spark.createDataFrame(rows, "k string, x double, y double, fwhm double")
    got = masks.star_runs(stars, ["k"], masks.star_radius(F.col("fwhm"), 2.0, 2.0, 5.0), 9, 12).collect()
    radius = lambda w: min(5.0, max(2.0, 2.0 * w)) if w and w > 0 else 2.0
    want = {(k, y, x) for k, sx, sy, w in rows if sx is not None for y in range(9) for x in range(12) if (x - sx) ** 2 + (y - (8 - sy)) ** 2 <= radius(w) ** 2}
    cells = [(r.k, r.y, x) for r in got for x in range(r.x0, r.x1 + 1)]
    assert len(cells) == len(set(cells)) and set(cells) == want
    wide = masks.dilated(spark.createDataFrame([("a", 0, 2, 3)], "k string, y int, x0 int, x1 int"), ["k"], 2, 9, 12).collect()
    assert {(r.y, x) for r in wide for x in range(r.x0, r.x1 + 1)} == {(y, x) for y in range(9) for x in range(12) if min(y * y + (x - c) ** 2 for c in (2, 3)) <= 4}
    assert masks.merged(stars.limit(0).selectExpr("k", "1 as y", "1 as x0", "1 as x1"), ["k"], 9, 12).count() == 0


def test_blur_passes_tile_edges(spark):
    from noctua.operators import masks, tiles

    image = np.random.default_rng(5).random((7, 9))
    rows = [("f", t["ty"], t["tx"], t["y0"], t["x0"], t["h"], t["w"], t["px"].tolist()) for t in tiles.cut_tiles(image, 4)]
    got = tiles.pixels(masks.blurred(spark.createDataFrame(rows, tiles.TILE), 4, 1.5, 4), ["frame_id"]).collect()
    line = np.exp(-(np.arange(-4, 5) ** 2) / (2 * 1.5**2))
    kernel, padded = np.outer(line, line) / line.sum() ** 2, np.pad(image, 4)
    want = {(y, x): (padded[y : y + 9, x : x + 9] * kernel).sum() for y in range(7) for x in range(9)}
    assert len(got) == 63 and all(abs(r.v - want[r.y, r.x]) < 1e-6 for r in got)


def test_ratio_clip_takes_back_rows_and_reports(spark):
    a = np.full(12, 100.0)
    b = np.array([200, 201, 199, 202, 198, 200, 203, 197, 200.5, 199.5, 900, 20.0])
    d = spark.createDataFrame([("p", float(x), float(y), []) for x, y in zip(a, b)] + [("p", 1.0, None, ["b_edge"]), ("q", 1.0, 2.0, [])], "k string, a double, b double, flags array<string>")
    got = {r.k: r for r in stats.star_scale_report(d, ["k"], "a", "b", "flags", least=8, min_r2=-1e9).collect()}
    assert got["p"].ok and got["p"].used == 10 and abs(got["p"].target_to_reference_scale - 0.5) < 1e-3 and got["p"].rejected == 3
    assert not got["q"].ok and got["q"].message == "too_few_points" and got["q"].used == 0 and got["q"].rejected == 1
    kept = np.arange(12) >= 0
    ratios = np.log(b / a)
    for _ in range(6):
        m = np.median(ratios[kept])
        s = 1.4826 * np.median(np.abs(ratios[kept] - m))
        kept = np.abs(ratios - m) <= 3 * s
    assert got["p"].used == kept.sum() and abs(got["p"].scale_b_over_a - np.median((b / a)[kept])) < 1e-12


@pytest.mark.parametrize("few", [stats.TASK_VALUES, 10])
def test_ranks_of_one_group_over_many_tasks(spark, few, monkeypatch):
    """The same in a task for each group, and over ranges where a group has more than `few` values."""
    monkeypatch.setattr(stats, "TASK_VALUES", few)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=3000), np.zeros(1500), [np.nan, np.inf]])
    rows = [("hot", float(x)) for x in v] + [("one", 4.0), ("none", None), (None, 1.0), (None, 3.0)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(16)
    good = np.sort(v[np.isfinite(v)])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        q = {r.k: r for r in stats.quantiles(d, ["k"], "v", [0.1, 0.5], ["a", "b"]).collect()}
        m = {r.k: r for r in stats.median_mad(d, ["k"], "v").collect()}
        p = stats.percentile_rank(d, ["k"], "v").collect()
        whole = stats.quantiles(d, [], "v", [0.5], ["b"]).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert q["hot"].n == 4500 and abs(q["hot"].a - np.quantile(good, 0.1)) < 1e-12 and q["hot"].b == np.median(good)
    assert q["one"].a == 4.0 and q["none"].n == 0 and q["none"].a is None and q[None].b == 2.0 and whole.n == 4503
    assert m["hot"].median == np.median(good) and abs(m["hot"].mad - np.median(np.abs(good - np.median(good)))) < 1e-12 and m["one"].mad == 0
    assert len(p) == len(rows) and all(r.pct is None or r.k != "hot" or abs(r.pct - (np.searchsorted(good, r.v, "right") - 1) / 4499) < 1e-12 for r in p)


def test_keys_named_like_columns_of_ranks(spark):
    d = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("b", 2, 1.0)], "x string, c int, v double")
    assert {tuple(r) for r in stats.median_mad(d, ["x", "c"], "v").select("x", "c", "median").collect()} == {("a", 1, 3.0), ("b", 2, 1.0)}
    assert {tuple(r) for r in stats.quantiles(d, ["c"], "c", [0.5], ["m"]).select("c", "m").collect()} == {(1, 1.0), (2, 2.0)}
    with pytest.raises(ValueError, match="named n"):
        stats.nearest_rank(d.withColumnRenamed("x", "n"), ["n"], "v", [0.5])


def test_a_scope_deletes_its_tables(spark):
    from noctua.session import scope, shared_dir

    before = set(os.listdir(shared_dir(spark)))
    with scope(spark):
        kept = written(spark.range(3), "outer")
        with scope(spark):
            inner = written(spark.range(4), "inner")
            assert inner.count() == 4
        assert kept.count() == 3 and len(set(os.listdir(shared_dir(spark))) - before) == 1
    assert set(os.listdir(shared_dir(spark))) == before


def test_last_values_are_carried_over_many_tasks(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    rng = np.random.default_rng(9)
    rows = [("hot" if i % 5 else None, int(t), i, float(i) if rng.random() < 0.02 else None) for i, t in enumerate(rng.permutation(3000))]
    try:
        got = stats.carried(spark.createDataFrame(rows, "k string, t int, i int, v double"), ["k"], ["t"], "v", "last").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for k in ("hot", None):
        last = None
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.t):
            last = r.v if r.v is not None else last
            assert r["last"] == last
    assert len(got) == 3000


def test_roles_of_one_group_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [("g", f"p{i:03}", [None, 5.0, float(rng.integers(9))][min(i, 2)], float(rng.integers(5)), float(rng.integers(5)), None if i == 7 else float(rng.integers(5))) for i in range(60)]
    got = {r.p: set(r.roles) for r in quality.select_roles(spark.createDataFrame(rows, "g string, p string, s double, n double, b double, c double"), ["g"], "p", "s", "n", "b", "c").collect()}
    want = {}
    put = lambda p, role: want.setdefault(p, set()).add(role)
    up = sorted((r[2], r[1]) for r in rows if r[2] is not None)
    for i in (1, 2, 3):
        put(up[-i][1], f"reference_rank_{i}")
    for q, role in ((0.5, "score_median"), (0.1, "score_p10"), (0.25, "score_p25"), (0.75, "score_p75")):
        put(up[round(q * (len(up) - 1))][1], role)
    for at, role, of in ((3, "max_bgnoise", max), (4, "max_background", max), (5, "min_star_count", min), (5, "max_star_count", max)):
        put(of((r[at], r[1]) for r in rows if r[at] is not None)[1], role)
    assert got == want


def test_nearest_without_a_bound(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 7.0), (3, "b", 0.0), (4, None, 5.0), (5, "a", None), (6, "c", 1.0), (7, "a", 100.0)], "i int, k string, v double")
    right = spark.createDataFrame([(10, "a", 4.0), (11, "a", 6.0), (12, "a", 4.0), (13, "b", None), (14, None, 5.0), (9, "a", 8.0), (20, "b", -3.0)], "r long, k string, w double")
    got = {r.i: (r.match_id, r.distance) for r in joins.match_nearest(left, right, "i", "v", "r", "w", ["k"]).collect()}
    assert got == {1: (10, 1.0), 2: (9, 1.0), 3: (20, 3.0), 4: (None, None), 5: (None, None), 6: (None, None), 7: (9, 92.0)}
    loose = {r.i: (r.match_id, r.distance) for r in joins.match_nearest(left, right, "i", "v", "r", "w", ["k"], within=1000.0).collect()}
    assert got == loose
    assert {r.i: r.match_id for r in joins.match_nearest(left, right, "i", "v", "r", "w", []).collect()}[6] == 10


def test_places_of_one_group_over_many_tasks(spark):
    d = spark.range(500).selectExpr("if(id < 400, 'a', null) as k", "cast((id * 37) % 101 as int) as v", "id").repartition(9)
    got = stats.sub_index(d, ["k"], ["v", "id"]).collect()
    for k in ("a", None):
        rows = sorted((r.v, r.id, r.sub_index) for r in got if r.k == k)
        assert [i for _, _, i in rows] == list(range(1, len(rows) + 1)) and len(rows) == (400 if k else 100)
    assert stats.sub_index(d.where("false"), ["k"], ["v", "id"]).count() == 0


def test_numbers_with_eight_digits_have_no_idle_zeros(spark):
    values = [300.0, 1500.5, 1e10, 123456789.0, 12345678.0, 0.0, -0.0, -2.5, 1.23456789012, 0.0001, 0.00001234, 99999999.6, 1e-300, 1e300, 0.1, None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", S.general(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [None if v is None else f"{abs(v) or 0:.8g}" if v == 0 else f"{v:.8g}" for v in values]
    key = spark.range(1).select(S.group_key(F.lit("M 31"), F.lit(10), F.lit(20), F.lit(300.0)).alias("k"), S.candidate_key(F.lit("a/b"), F.lit("Ha"), F.lit(None).cast("double"), F.lit(4), F.lit(3)).alias("c")).first()
    assert (key.k, key.c) == ("M_31_300_10x20", "a_b_Ha_1_4x3")


def test_equal_outliers_are_dropped_by_path(spark):
    """20 good frames and five equal outliers with a cap of three: the first three by path go."""
    rows = [("g", f"a{i:02}", 100.0 + i % 3) for i in range(20)] + [("g", f"z{c}", 1.0) for c in "abcde"]
    got = quality.drop_policy(spark.createDataFrame(rows, "g string, p string, s double"), ["g"], "s", "p", fraction=0.13).collect()
    assert sorted(r.p for r in got if r.drop_status == "dropped_quality_outlier") == ["za", "zb", "zc"]
    assert [r.p for r in sorted(got, key=lambda r: r.quality_rank)][:3] == ["a02", "a05", "a08"]
    # dropped first, then the best of them, by path, come back
    rows = [("g", p, 9.0) for p in "abcdefgh"] + [("g", "x", 1.0), ("g", "y", 1.0)]
    got = quality.drop_policy(spark.createDataFrame(rows, "g string, p string, s double"), ["g"], "s", "p", min_frames=9, fraction=0.5).collect()
    assert {r.p: r.drop_status for r in got} == {"a": "reference", **dict.fromkeys("bcdefghx", "kept"), "y": "dropped_quality_outlier"}


@pytest.mark.parametrize("few", [stats.TASK_VALUES, 2])
def test_drop_policy_as_row_by_row(spark, few, monkeypatch):
    monkeypatch.setattr(stats, "TASK_VALUES", few)
    rng = np.random.default_rng(6)
    rows = [(g, f"p{i:02}", None if rng.random() < 0.05 else float(rng.choice([1, 2, 50, 51, 52, 53], p=[0.1, 0.1, 0.2, 0.2, 0.2, 0.2]))) for g, n in (("a", 40), ("b", 25), ("c", 2), (None, 30)) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, p string, s double")
    for min_frames, fraction in ((3, 0.15), (20, 0.3), (28, 0.5), (39, 0.9)):
        got = {(r.g, r.p): r for r in quality.drop_policy(d, ["g"], "s", "p", min_frames, fraction).collect()}
        for g in ("a", "b", "c", None):
            own = sorted(((s, p) for k, p, s in rows if k == g and s is not None), key=lambda x: (-x[0], x[1]))
            if len(own) < min_frames:
                assert all(got[g, p].drop_status == "too_few_valid_scores" for _, p in own)
                continue
            up = sorted(s for s, _ in own)
            q1, q3 = up[round(0.25 * (len(up) - 1))], up[round(0.75 * (len(up) - 1))]
            out = sorted((x for x in own[1:] if x[0] < q1 - 1.5 * (q3 - q1)), key=lambda x: (x[0], x[1]))[: int(len(own) * fraction)]
            back = sorted(out, key=lambda x: (-x[0], x[1]))[: max(0, min_frames - (len(own) - len(out)))]
            gone = {p for _, p in out} - {p for _, p in back}
            assert {p for _, p in own if got[g, p].drop_status == "dropped_quality_outlier"} == gone
            assert [p for _, p in own if p not in gone] == [p for i, p in sorted((got[g, p].sequence_index, p) for _, p in own if p not in gone)]
            assert [got[g, p].quality_rank for _, p in own] == list(range(1, len(own) + 1))


def test_measures_give_errors_as_rows(spark):
    kinds = "frame_id string, ty int, tx int, h int, w int, px array<float>"
    rows = [("a", 0, 0, 2, 2, [1.0, 2.0, 3.0, 4.0]), ("b", 0, 0, 1, 2, [1.0, None]), ("c", 0, 0, 2, 2, None), ("d", 0, 0, 2, 2, [1.0])]
    got = {(r.frame_id, r.measure): r for r in measures.measured(spark.createDataFrame(rows, kinds), ["gradient", "extremes"]).collect()}
    assert len(got) == 8 and got["a", "gradient"].result == {"rows": 2.0, "columns": 1.0} and got["b", "extremes"].result == {"low": 1.0, "high": 1.0}
    assert {k for k, r in got.items() if r.error} == {("b", "gradient"), ("c", "gradient"), ("c", "extremes"), ("d", "gradient"), ("d", "extremes")}
    with pytest.raises(ValueError, match="no such measure: other"):
        measures.measured(spark.createDataFrame(rows, kinds), ["other"])
    with pytest.raises(ValueError, match="exists"):
        measures.register("gradient", "x")(lambda image: (0.0,))
