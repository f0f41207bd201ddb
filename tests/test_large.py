"""Plans and results that matter on large tables: no gathered groups, no broadcast of a large side, ties as in the SQL."""

import pytest
from pyspark.sql import functions as F

from noctua.operators import joins, lnc, quality, stats
from noctua.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_points_never_sends_a_side_through_the_driver(spark):
    d = spark.range(100).select(F.lit("f").alias("f"), "id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert "BroadcastHashJoin" in plan(d.join(d.select("id", F.col("x").alias("z")), "id"))
    assert "BroadcastHashJoin" not in plan(joins.cross_match(d, d, ["f"], 1.5))



def test_isolation_never_sends_a_side_through_the_driver(spark):
    d = spark.range(100).select(F.lit("f").alias("f"), "id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = joins.isolation(d, ["f"], 1.5)
    assert "BroadcastHashJoin" not in plan(got)
    assert {r.nearest for r in got.collect()} == {1.0}


def test_blended_roles_of_strengths_that_differ_by_a_bit_take_the_larger_path(spark):
    bit = 2.0**-50
    shares = "score double, stars double, flux double, background double, gradient double, r2 double, patchiness double, rng double, valid double"
    rows = [("g", p, 0.5 + (bit if p == 1 else 0), 0.5, 0.5, 0.5 + (bit if p == 3 else 0), 0.5, 0.5, 0.5, 0.5, 0.5) for p in range(1, 6)]
    d = spark.createDataFrame(rows, f"g string, path int, {shares}")
    pct = {c: c for c in ("score", "stars", "flux", "background", "gradient", "r2", "patchiness")} | {"range": "rng"}
    got = {r.role: r.path for r in quality.blended_roles(d, ["g"], "path", pct, "valid").collect()}
    assert (got["illum_reference_rank_1"], got["illum_reference_rank_2"], got["bright_gradient"]) == (5, 4, 3)


def test_numbered_lines_of_files_cut_into_splits(spark, tmp_path):
    """A file goes to several tasks, each of which holds a split only; lines keep their numbers, and CRLF and empty lines count."""
    want = [("a.txt", i, f"line {i}") for i in range(5000) if i % 7] + [("b.txt", 0, "one"), ("b.txt", 2, "three")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"".join(b"\r\n" if i % 7 == 0 else f"line {i}\r\n".encode() for i in range(5000)))
    (tmp_path / "in/b.txt").write_bytes(b"one\n\nthree")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.numbered_lines(spark, str(tmp_path / "in"))
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "wholetext" not in plan(got) and not [n for n in plan(got).split() if "Generate" in n]
    assert sorted((r.file.rpartition("/")[2], r.line, r.value) for r in rows) == want


def test_clipped_ratio_of_large_groups_gathers_none(spark, monkeypatch):
    d = spark.range(4000).select((F.col("id") % 2).alias("g"), (1 + F.col("id") % 97).cast("double").alias("a"), (3 + F.col("id") * 7919 % 1009).cast("double").alias("b"))
    d = d.unionByName(d.where("g = 0 and a < 9"))
    want = {r.g: r for r in stats.clipped_ratio(d, ["g"], "a", "b", 1.5, 3, 3).collect()}
    monkeypatch.setattr(stats, "TASK_VALUES", 10)
    monkeypatch.setattr(stats, "BINS", 8)
    used, real = [], stats._middle
    monkeypatch.setattr(stats, "_middle", lambda *a: used.append(1) or real(*a))
    for r in stats.clipped_ratio(d, ["g"], "a", "b", 1.5, 3, 3).collect():
        assert r.used == want[r.g].used < 2000 + 200
        for name in ("ratio", "ratio_mad", "mad", "low", "high"):
            assert r[name] == pytest.approx(want[r.g][name], rel=1e-12)
    assert used


def test_clipped_line_of_large_groups_gathers_none(spark, monkeypatch):
    d = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 50).cast("double").alias("x"), (F.col("id") * 7919 % 1009).cast("double").alias("y"))
    d = d.unionByName(spark.createDataFrame([(2, 1.0, 1.0)], "g long, x double, y double"))
    small = {r.g: r for r in stats.clipped_line_fit_grouped(d, ["g"], "x", "y", 1.5, 5).collect()}
    monkeypatch.setattr(stats, "TASK_VALUES", 10)
    got = stats.clipped_line_fit_grouped(d, ["g"], "x", "y", 1.5, 5)
    assert "Pandas" not in plan(got)
    for r in got.collect():
        assert r.n == small[r.g].n
        for name in ("slope", "intercept", "std"):
            assert r[name] == (pytest.approx(small[r.g][name]) if small[r.g][name] is not None else None)


def test_models_of_a_node_are_fitted_in_one_pass(spark):
    rows = [("p", 0, 0, [float(i + j) for i in range(20)], [float(2 * i + j) for i in range(20)]) for j in range(3)] + [("q", 0, 1, [1.0], [2.0])]
    d = spark.createDataFrame(rows, "pair_id string, gy int, gx int, ref array<double>, target array<double>")
    models = [(m, e) for m in ("affine", "additive") for e in ("median", "mean")]
    options = {"gain": 1.1, "low": 0.05, "least": 8, "min_samples": 12}
    fit = lnc.fit_models(d, models, **options)
    assert plan(fit).count("MapInPandas") == 1 and "FlatMapGroupsInPandas" not in plan(fit)
    got = {(r.model, r.estimator): r for r in fit.collect()}
    assert set(got) == set(models)
    for m, e in models:
        one = lnc.fit_nodes(d, m, e, **options).first()
        assert (one.scale, one.offset, one.ref_bg, one.used, one.clamped) == tuple(got[m, e][c] for c in ("scale", "offset", "ref_bg", "used", "clamped"))


def test_role_pairs_of_one_group_go_to_many_tasks(spark):
    d = spark.range(2000).select(F.lit("b").alias("g"), "id")
    got = quality.role_pairs(d, ["g"], "id", F.col("id") % 100 == 0)
    assert got.count() == got.distinct().count() == 20 * 1980
    assert "_part" in plan(got) and got.columns == ["g", "reference_path", "target_path"]


def test_scans_of_small_files_pack_their_splits(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.txt").write_text(f"found {i} stars\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        logs = files.scan_tool_logs(spark, str(tmp_path))
        assert logs.rdd.getNumPartitions() <= 8
        assert files.discover_images(spark, str(tmp_path), r"\.txt$").count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.stars for r in logs.collect()) == list(range(300))
