"""Sources and sinks on generated files, and streams against their batch forms."""

import datetime as dt
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from noctua.operators import logs
from noctua.sources import files, headers, sinks, store
from noctua.streaming import telemetry


def fits(path, cards, data=None):
    cards = {"SIMPLE": "T", "BITPIX": "-32", "NAXIS": "0"} | cards
    if data is not None:
        cards |= {"NAXIS": str(data.ndim)} | {f"NAXIS{i + 1}": str(n) for i, n in enumerate(reversed(data.shape))}
    text = "".join(f"{k:<8}= {v if v[0] in '-0123456789TF' else repr(v):<70}"[:80].ljust(80) for k, v in cards.items()) + "END".ljust(80)
    body = b"" if data is None else data.astype(">f4").tobytes()
    path.write_bytes(text.encode().ljust(-(-len(text) // 2880) * 2880) + body.ljust(-(-len(body) // 2880) * 2880, b"\0"))


def test_headers_of_both_kinds(spark, tmp_path):
    root = tmp_path / "in"
    (root / ".cache").mkdir(parents=True)
    fits(root / "a.fit", {"DATE-OBS": "2026-02-03T04:05:06", "FILTER": "R", "EXPTIME": "120", "GAIN": "56", "CCD-TEMP": "8.0", "FOCUSTEM": "13.25"})
    fits(root / ".hidden.fit", {})
    fits(root / ".cache" / "d.fits", {})
    (root / "bad.fits").write_bytes(b"not a header")
    (root / "notes.txt").write_text("x")
    ids = {"Observation:Time:Start": "2026-02-03T04:05:06", "Instrument:Filter:Name": "'Ha'", "Observation:ExposureTime": "180", "CCD:Gain": "100", "CCD:Temperature": "10"}
    xml = ("<xisf>" + "".join(f'<Property id="{k}" value="{v}"/>' for k, v in ids.items()) + "</xisf>").encode()
    (root / "b.xisf").write_bytes(b"XISF0100" + struct.pack("<I", len(xml)) + b"\0" * 4 + xml)
    assert sorted(r.path.rpartition("/")[2] for r in files.discover_images(spark, str(root)).collect()) == ["a.fit", "b.xisf", "bad.fits"]
    heads = headers.scan_headers(spark, str(root))
    assert [r.path.rpartition("/")[2] for r in heads.where("err is not null").collect()] == ["bad.fits"]
    got = {r.path.rpartition("/")[2]: r for r in files.typed_frames(heads).collect()}
    assert (got["a.fit"].exptime, got["a.fit"].gain, got["a.fit"].focus_temp, got["a.fit"].filter) == (120.0, 56, 13.25, "R")
    assert (got["b.xisf"].filter, got["b.xisf"].gain, got["b.xisf"].date_obs) == ("Ha", 100, dt.datetime(2026, 2, 3, 4, 5, 6))


def test_headers_are_read_without_their_pixels(spark, tmp_path):
    """Large pixels, a header of several blocks, XML beyond the first block, and files that are cut off."""
    fits(tmp_path / "large.fits", {"FILTER": "R"}, np.zeros((400, 500)))
    fits(tmp_path / "long.fits", {f"KEY{i}": str(i) for i in range(100)} | {"FILTER": "G"}, np.zeros((300, 300)))
    xml = ("<xisf>" + "".join(f'<Property id="P{i}" value="{i}"/>' for i in range(400)) + '<Property id="OBSERVATION:FILTER" value="B"/></xisf>').encode()
    (tmp_path / "wide.xisf").write_bytes(b"XISF0100" + struct.pack("<I", len(xml)) + b"\0" * 4 + xml + b"\1" * 1_000_000)
    (tmp_path / "cut.fits").write_bytes((tmp_path / "long.fits").read_bytes()[:3000])
    (tmp_path / "empty.fit").write_bytes(b"")
    (tmp_path / "cut.xisf").write_bytes(b"XISF0100")
    got = {r.path.rpartition("/")[2]: r for r in headers.scan_headers(spark, str(tmp_path)).collect()}
    assert {n for n, r in got.items() if r.err} == {"cut.fits", "cut.xisf"}
    assert got["large.fits"].bytes_read == 2880 and got["long.fits"].bytes_read == 3 * 2880 and got["wide.xisf"].bytes_read == max(2880, 16 + len(xml))
    frames = files.typed_frames(headers.scan_headers(spark, str(tmp_path)))
    assert {r.path.rpartition("/")[2]: r.filter for r in frames.collect()} == {"large.fits": "R", "long.fits": "G", "wide.xisf": "B"}


def test_measuring_goes_on_where_it_broke_off(spark, tmp_path):
    calls = []

    def measure(part):
        calls.append(sorted(r.path for r in part.collect()))
        if len(calls) == 3:
            raise RuntimeError("lost")
        return part.select("path", "mtime", (F.col("size") * 2).alias("score"))

    work = spark.createDataFrame([(f"f{i}", 10.0 + i, i) for i in range(12)], "path string, mtime double, size long")
    cache = store.MeasurementCache(spark, str(tmp_path / "cache"))
    with pytest.raises(RuntimeError, match="lost"):
        cache.fill(work, measure, 4, F.col("size"))
    assert cache.missing(work).count() == 6
    assert store.MeasurementCache(spark, str(tmp_path / "cache")).fill(work, measure, 4, F.col("size")) == 2
    assert sorted(sum(calls[:2] + calls[3:], [])) == sorted(f"f{i}" for i in range(12))
    touched = work.withColumn("mtime", F.when(F.col("path") == "f3", 99.0).otherwise(F.col("mtime"))).withColumn("size", F.col("size") + 1)
    assert cache.fill(touched, measure, 1) == 1 and calls[-1] == ["f3"]
    want = {f"f{i}": 2 * i for i in range(12)} | {"f3": 8}
    assert {r.path: r.score for r in cache.read().collect()} == want
    cache.compact()
    assert len(cache.folder.commits()) == 1 and {r.path: r.score for r in cache.read().collect()} == want
    assert cache.fill(touched, measure) == 0 and cache.fill(touched, measure, force=True) == 1
    # what a lost job has left does not count
    (tmp_path / "cache" / "commit-99").mkdir()
    assert cache.read().count() == 12


def test_a_gate_lets_only_whole_provenance_through(spark, tmp_path):
    path = str(tmp_path / "out")
    store.write_gated(spark.createDataFrame([(1.0, 2), (3.0, 4)], "exposure double, mode int"), path)
    with pytest.raises(ValueError, match="of 3 rows 1 lack exposure, 2 lack mode"):
        store.write_gated(spark.createDataFrame([(1.0, None), (None, None), (1.0, 2)], "exposure double, mode int"), path)
    assert spark.read.parquet(path).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    store.write_gated(spark.createDataFrame([(1.0, 2)], "exposure double, mode int"), path)
    assert spark.read.parquet(path).count() == 1


def test_each_light_is_calibrated_once(spark, tmp_path):
    kinds = "frame_id string, ty int, tx int, gain int, filter string, px array<double>"
    lights = [(f"l{i}", 0, t, i % 2, "R" if i % 3 else "G", [10.0 + i, 20.0 + t]) for i in range(6) for t in range(2)]
    dark = spark.createDataFrame([(g, 0, t, [1.0 + g, 2.0]) for g in range(2) for t in range(2)], "gain int, ty int, tx int, px array<double>")
    flat = spark.createDataFrame([("R", 0, t, [2.0, 0.0]) for t in range(2)], "filter string, ty int, tx int, px array<double>")
    got = telemetry.Calibration(spark, str(tmp_path / "out"), dark, ["gain"], flat, ["filter"])
    for part in (lights[:7], lights[5:]):  # some come again
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        telemetry.run_available(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), got.add, str(tmp_path / "state")).awaitTermination(60)
    got.add(spark.createDataFrame(lights[5:], kinds), 1)  # a batch that is run again
    want = {(f, ty, tx): [px[0] - 1 - g, px[1] - 2] if flt == "G" else [(px[0] - 1 - g) / 2, None] for f, ty, tx, g, flt, px in lights}
    rows = got.read().collect()
    assert len(rows) == 12 and {(r.frame_id, r.ty, r.tx): r.px for r in rows} == want


def test_tiles_of_an_image(spark, tmp_path):
    image = np.arange(20, dtype=float).reshape(4, 5)
    fits(tmp_path / "a.fits", {}, image)
    got = files.scan_tiles(spark.read.format("binaryFile").load(str(tmp_path)), 3).orderBy("ty", "tx").collect()
    assert [(r.y0, r.x0, r.h, r.w) for r in got] == [(0, 0, 3, 3), (0, 3, 3, 2), (3, 0, 1, 3), (3, 3, 1, 2)]
    assert got[1].px == [3.0, 4.0, 8.0, 9.0, 13.0, 14.0]


def test_analyze_log(spark, tmp_path):
    (tmp_path / "one.analyze").write_text("AnalyzeStartTime,2026-01-01 20:00:00.000,CET\nCaptureComplete,60.5,120,R,bad,/x/Light/a.fits\nAutofocusComplete,90,11.5,,L,1000|2.0|1010|1.5|1020|2.2\n")
    (tmp_path / "two.analyze").write_text("CaptureComplete,1,30,L,1.5,/x/flat/b.fits\n")
    events = logs.analyze_events(files.numbered_lines(spark, str(tmp_path)))
    got = logs.captures(events).collect()
    assert [(r.kind, r.hfr, r.exposure_s, r.at) for r in got] == [("light", None, 120.0, dt.datetime(2026, 1, 1, 20, 1, 0, 500000))]
    assert [(r.focus_position, r.hfr) for r in logs.focus_results(events).collect()] == [(1010.0, 1.5)]


def test_star_lists_and_sequences(spark, tmp_path):
    (tmp_path / "plain.lst").write_text("1 1 1 1 1 12.5 14.5 3.0 3.0\nbroken row\n2 1 1 1 1 20 25 3 3\n")
    (tmp_path / "head.lst").write_text("# x y fwhm roundness\n10.5 20.25 3.2 0.1\n11 21 3.0 0.2\n")
    got = {(r.file.rpartition("/")[2], r.x): (r.y, r.fwhm) for r in files.scan_star_lists(spark, str(tmp_path)).collect()}
    assert got == {("plain.lst", 12.5): (14.5, 3.0), ("plain.lst", 20.0): (25.0, 3.0), ("head.lst", 10.5): (20.25, 3.2), ("head.lst", 11.0): (21.0, 3.0)}
    seq = tmp_path / "s"
    seq.mkdir()
    (seq / "a.seq").write_text("S 'r_pp' 1 2 2 5 1 5 0 0\nL 1\nI 1 1 100,80\nI 2 0 100,90\nR0 1 1 1 1 1 1 H 1 0 4 0 1 -3 0 0 1\nR0 1 1 1 1 1 1 H 1 0 0 0 1 0 0 0 1\n")
    s, frames = files.scan_sequences(files.numbered_lines(spark, str(seq)))
    assert (s.first().name, s.first().number) == ("r_pp", 2)
    f = frames.orderBy("place").collect()
    assert [(r.width, r.height, r.included) for r in f] == [(100, 80, True), (100, 90, False)] and f[0].m == [1, 0, 4, 0, 1, -3, 0, 0, 1]


def test_tool_log(spark, tmp_path):
    (tmp_path / "t.log").write_text("Found 120 stars\nFound 118 stars\nbgnoise: 0.5\nbgnoise: 0.01234\nImage center: RA: 05h35m17s, DEC: -05 23 28\n")
    r = files.scan_tool_logs(spark, str(tmp_path)).first()
    assert (r.stars, r.bgnoise) == (120, 0.01234) and r.dec_degrees == pytest.approx(-5.391111, abs=1e-5)


def test_projects_reports_and_labels(spark, tmp_path):
    p = {"latitude": 31.5, "targets": [{"target": "M31", "filters": {"L": {"exposure": 300, "target_frames": 3}, "R": {"exposure": 300, "target_frames": 1, "gain": 100}}}]}
    (tmp_path / "p.json").write_text(json.dumps(p))
    got = {r.filter: r for r in files.scan_projects(spark, str(tmp_path / "p.json")).collect()}
    assert got["L"].target_frames == 3 and (got["L"].gain, got["R"].gain, got["R"].mode) == (56, 100, 5)
    (tmp_path / "r.json").write_text(json.dumps({"input_dir": "/in", "rows": [{"source_file": "/in/a", "final_filter": "L", "extra": 1}]}))
    assert files.scan_report(spark, str(tmp_path / "r.json")).first().final_filter == "L"
    (tmp_path / "c.jsonl").write_text('{"left_path": "a", "right_path": "b", "winner": "maybe"}\n')
    with pytest.raises(Exception, match="bad winner maybe"):
        files.scan_comparisons(spark, str(tmp_path / "c.jsonl")).collect()


def test_focus_log_drops_bad_rows(spark, tmp_path):
    head = "datetime , filter, temperature, initial_focus, best_focus, num_stars, fwhm, r_squared, num_samples, focus_min, focus_max\n"
    (tmp_path / "f.csv").write_text(head + "2026-01-01 20:00:00, L, 10.5, 1000, 1010, 50, 2.1, 0.95, 9, 900, 1100\n2026-01-01 21:00:00, L, 10.5, 1000, , 50, 2.1, 0.95, 9, 900, 1100\n2026-01-01 22:00:00, L, 9.5, 1000, 1012, 50, 2.1, 0.5, 9, 900, 1100\n")
    got = files.scan_focus_log(spark, str(tmp_path / "f.csv"), 0.9).collect()
    assert [(r.filter, r.best_focus) for r in got] == [("L", 1010.0)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.23456789012, "L"), ("b", float("nan"), "R")], "path string, score double, filter string")
    sinks.write_csv(d, str(tmp_path / "c"), one_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert "a,1.2345679,L" in text and "b,,R" in text
    for rows in (d, d.limit(1)):
        sinks.rewrite_table(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    doc = json.loads(sinks.calibration_document(spark.createDataFrame([("L", 1.5), ("R", 2.5)], "filter string, slope double"), "L", "2026").first().document)
    assert doc["reference_filter"] == "L" and doc["filters"]["R"]["slope"] == 2.5


def _events():
    t0 = dt.datetime(2026, 1, 1)
    values = [1, 9, 9, 9, 9, 1, 9, 9, 9, 9, 9, 9, 2, 4, 9]
    return [(k, i, t0 + dt.timedelta(seconds=20 * i + (5 if k == "b" else 0)), float(v), "OPEN" if v > 8 else "CLOSED" if v > 1 else "UNKNOWN") for k in ("a", "b") for i, v in enumerate(values)]


class Parts:
    """A stream whose rows come in parts; `run` processes each part with a rule of its own state and gives all rows it gave."""

    def __init__(self, spark, folder, parts):
        self.spark, self.folder, self.parts = spark, folder, parts

    def run(self, rule, name):
        late = 0
        for i, part in enumerate(self.parts):
            part.coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}/in")
            df = rule(self.spark.readStream.schema(part.schema).parquet(f"{self.folder}/{name}/in"))
            q = df.writeStream.format("parquet").option("path", f"{self.folder}/{name}/out").option("checkpointLocation", f"{self.folder}/{name}/state").trigger(availableNow=True).start()
            assert q.awaitTermination(120), i
            late += telemetry.late_rows(q)
        return sorted(map(tuple, self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}/out").collect())), late


def test_streams_agree_with_their_batch_forms(spark, tmp_path):
    """Rows out of order within the delay count as if they had come in order; rows behind the watermark are dropped."""
    rows = _events()
    kinds = "k string, i int, t timestamp, v double, s string"
    e = spark.createDataFrame(rows, kinds)
    late = [("a", 99, rows[0][2] - dt.timedelta(seconds=500), 9.0, "CLOSED")]
    end = [("end", 0, rows[-1][2] + dt.timedelta(hours=2), 0.0, "OPEN")]
    order = sorted(rows, key=lambda r: (r[1] * 7) % 15)  # disordered by less than the delay of 400 seconds
    parts = Parts(spark, tmp_path, [spark.createDataFrame(p, kinds) for p in (order[:14], order[14:], end, late, end)])
    batch = telemetry.drift_alerts(e, "k", "t", "v", 5, 50, "i")
    got, dropped = parts.run(lambda s: telemetry.drift_stream(s, "k", "t", "v", 5, 50, "400 seconds", "i"), "drift")
    assert got == sorted(map(tuple, batch.collect())) and dropped == 1
    parts = Parts(spark, tmp_path, parts.parts[:3])
    batch = telemetry.transitions(e, "k", ["t", "i"], "s").select("k", "t")
    assert parts.run(lambda s: telemetry.transition_stream(s, "k", "t", "s", delay="400 seconds"), "roof")[0] == sorted(map(tuple, batch.collect()))
    batch = telemetry.latched_levels(e, "k", "t", "v", 5, 2)
    assert parts.run(lambda s: telemetry.latch_stream(s, "k", "t", "v", 5, 2, "400 seconds"), "latch")[0] == sorted(map(tuple, batch.collect()))
    batch = telemetry.sliding_rms(e.withColumn("d", F.col("v") - 5), ["k"], "t", "v", "d", 60).select("k", "t", "rms_ra", "rms_dec", "rms_total")
    got, _ = parts.run(lambda s: telemetry.rms_stream(s.withColumn("d", F.col("v") - 5), "k", "t", "v", "d", 60, "400 seconds"), "rms")
    want = sorted(map(tuple, batch.collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2:] for r in got] == [pytest.approx(r[2:]) for r in want]
    bad = F.col("v") > 8
    batch = telemetry.failure_limits(e, "k", ["t", "i"], bad, 3).select("k", "t")
    assert parts.run(lambda s: telemetry.failure_stream(s.withColumn("f", bad), "k", "t", "f", 3, "400 seconds", "i"), "failures")[0] == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("from_start", [False, True])
def test_unknown_states_warn_by_time_alone(spark, tmp_path, from_start):
    t0 = dt.datetime(2026, 1, 1)
    states = {"a": ["UNKNOWN", None, "OPEN", "UNKNOWN", "UNKNOWN", "OPEN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"], "b": ["OPEN", "UNKNOWN"]}
    rows = [(k, t0 + dt.timedelta(seconds=30 * i), v) for k, vs in states.items() for i, v in enumerate(vs)]
    kinds = "k string, t timestamp, s string"
    order = [rows[i] for i in (3, 0, 5, 1, 11, 4, 2, 9, 8, 10, 6, 7)]
    parts = Parts(spark, tmp_path, [spark.createDataFrame(p, kinds) for p in (order[:5], order[5:], [("end", t0 + dt.timedelta(hours=1), "OPEN")])])
    got, _ = parts.run(lambda s: telemetry.unknown_stream(s, "k", "t", "s", 59.5, "10 minutes", from_start), "unknown")
    at = lambda s: t0 + dt.timedelta(seconds=s)
    want = [("a", at(90), at(149.5)), ("a", at(180), at(239.5)), ("b", at(30), at(89.5))]
    assert got == sorted(want + ([("a", at(0), at(59.5))] if from_start else []))


def test_files_are_ready_once_they_rest(spark, tmp_path):
    frames, store = tmp_path / "frames", str(tmp_path / "sightings")
    frames.mkdir()
    at = lambda s: F.lit(dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)).cast("timestamp")

    def step(second):
        telemetry.record_sightings(spark, str(frames), store, at(second))
        s = spark.readStream.schema("path string, length long, modificationTime timestamp, seen_at timestamp").parquet(store)
        q = telemetry.stable_file_stream(s, "path", "length", "modificationTime", "seen_at", 2.0, "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r.path.rpartition("/")[2], r.length) for r in spark.read.schema("path string, length long, mtime timestamp, ready_at timestamp").parquet(str(tmp_path / "out")).collect())

    (frames / "a.fit").write_bytes(b"1")
    (frames / "note.txt").write_bytes(b"1")
    step(0)
    (frames / "a.fit").write_bytes(b"12345")  # it grows between two listings
    (frames / "b.fits").write_bytes(b"12")
    step(1)
    assert step(2) == []
    step(4)
    assert step(8) == [("a.fit", 5), ("b.fits", 2)]
    assert step(20) == [("a.fit", 5), ("b.fits", 2)]


def test_incremental_run_sees_only_new_files(spark, tmp_path):
    seen = []
    one = spark.range(3).withColumn("at", F.current_timestamp())
    one.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = spark.readStream.schema(one.schema).parquet(str(tmp_path / "in"))
        telemetry.run_available(s, lambda b, i: seen.append(b.count()), str(tmp_path / "ck")).awaitTermination(60)
    spark.range(2).withColumn("at", F.current_timestamp()).write.mode("append").parquet(str(tmp_path / "in"))
    telemetry.run_available(spark.readStream.schema(one.schema).parquet(str(tmp_path / "in")), lambda b, i: seen.append(b.count()), str(tmp_path / "ck")).awaitTermination(60)
    assert seen == [3, 2]
