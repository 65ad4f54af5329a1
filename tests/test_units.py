"""Hand-computed cases."""

import json
import tracemalloc
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlab.functions import scalars as sc
from tandemlab.operators import grouped, joins, learn
from tandemlab.operators import series as ts
from tandemlab.operators import stats as st
from tandemlab.sources import files
from tandemlab.streaming import markers


def one(df):
    return df.collect()[0]


def test_scalars(spark):
    rows = spark.createDataFrame([(v,) for v in ("1.9", "-1.9", "", "x", "inf", "nan", None)], "v string")
    assert [tuple(r) for r in rows.select(sc.safe_double(F.col("v")), sc.safe_long(F.col("v"))).collect()] == [(1.9, 1), (-1.9, -1), *[(None, None)] * 5]
    assert one(spark.range(1).select(sc.filetime_ms(F.lit(116444736000000000) + 12345).alias("t"))).t == 1
    assert one(spark.range(1).select(sc.filetime_ms(F.lit(116444736000009999)).alias("t"))).t == 0
    assert [r[0] for r in spark.createDataFrame([("T01",), ("t7",), (" 3 ",), ("warm-up",), ("Tx",), ("",), (None,)], "v string").select(sc.trial_label(F.col("v"))).collect()] == ["1", "7", "3", "warm-up", "x", "", ""]
    assert [r[0] for r in spark.createDataFrame([(1, 0.5), (2, 0.5), (2, 0.0)], "t long, o double").select(sc.shifted(F.col("t"), F.col("o"))).collect()] == [2, 2, 2]
    seen = spark.createDataFrame([(600.0, 400.0, "matcher"), (600.0, 400.0, "director"), (600.0, 400.0, None), (650.0, 30.0, "director"), (None, 1.0, "matcher"), (1200.0, 10.0, "matcher")], "x double, y double, role string")
    assert [r[0] for r in seen.select(sc.area_of(F.col("x"), F.col("y"), F.col("role"))).collect()] == ["map", "other", "other", "timer", "missing", "toolbar"]
    assert one(spark.range(1).select(sc.iso_time(F.lit(1)).alias("t"))).t == "1970-01-01T00:00:00.001Z"
    pupils = spark.createDataFrame([(3.0, 4.0), (3.0, -1.0), (None, 2.0), (None, 0.0)], "l double, r double")
    assert [r[0] for r in pupils.select(sc.mean_pupil(F.col("l"), F.col("r"))).collect()] == [3.5, 3.0, 2.0, None]


def test_constant_series_have_no_correlation_or_slope(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert tuple(one(rows.agg(sc.corr("x", "y"), sc.slope(F.col("y"), F.col("x"))))) == (None, None)


def test_interval_ends_are_closed(spark):
    points = spark.createDataFrame([(k, 0, t) for k, t in enumerate((99, 100, 150, 200, 201, 250))], "id long, k int, t long")
    spans = spark.createDataFrame([(0, 100, 200, "a"), (0, 150, 200, "b"), (0, 250, 250, "c")], "k int, start long, end long, label string")
    found = joins.first_interval(points, spans, ["k"], "t", "start", "end", "label", 40, "id")
    assert sorted(map(tuple, found.collect())) == [(0, "none"), (1, "a"), (2, "a"), (3, "a"), (4, "none"), (5, "c")]


def test_nearest_in_time_prefers_the_earlier(spark):
    left = spark.createDataFrame([(1, 0, 10), (2, 0, 100)], "id long, k int, t long")
    right = spark.createDataFrame([(0, 5, 1.0), (0, 15, 2.0)], "k int, t long, v double")
    found = joins.asof_nearest(left, right, ["k"], "t", "v", 50, "id")
    assert sorted(map(tuple, found.collect())) == [(1, 10, 5, 1.0), (2, 100, None, None)]


def test_wilson(spark):
    found = one(st.wilson(spark.createDataFrame([(1, 0)] * 5, "g int, y int"), "y", ["g"]))
    assert (found.low, round(found.high, 4)) == (0.0, 0.4345)


def test_auc_ties_and_single_class(spark):
    rows = spark.createDataFrame([(0, 1.0, 1), (0, 1.0, 0), (0, 2.0, 1), (1, 5.0, 1)], "g int, s double, y int")
    assert {r.g: r.auc for r in st.roc_auc(rows, "s", "y", ["g"]).collect()} == {0: 0.75, 1: None}


def test_average_ranks(spark):
    rows = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0)], "v double")
    assert sorted((r.v, r["rank"]) for r in st.average_ranks(rows, "v").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_running_sums_without_keys(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=400) ** 3, 1)
    rows = spark.createDataFrame([(float(v), int(k % 3 == 0)) for k, v in enumerate(values)], "v double, y int")
    ranks = {r.v: r["rank"] for r in st.average_ranks(rows, "v").collect()}
    assert ranks == {v: (values < v).sum() + ((values == v).sum() + 1) / 2 for v in values}
    order, ap, hits = sorted(set(values), reverse=True), 0.0, sum(k % 3 == 0 for k in range(400))
    for v in order:
        above = values >= v
        ap += sum(k % 3 == 0 for k in np.flatnonzero(values == v)) / hits * sum(k % 3 == 0 for k in np.flatnonzero(above)) / above.sum()
    assert one(st.average_precision(rows, "v", "y")).ap == pytest.approx(ap)
    same = spark.createDataFrame([(1.0, 1), (1.0, 0)], "v double, y int")
    assert one(st.roc_auc(same, "v", "y")).auc == 0.5


def test_shuffle_keeps_group_sums(spark):
    rows = spark.createDataFrame([(k, k % 4, k % 3 % 2) for k in range(40)], "id long, g long, y int")
    want = {r.g: r[1] for r in rows.groupBy("g").sum("y").collect()}
    dealt = st.shuffled_within(rows, "g", "id", "y", 3, 1).join(rows.select("id", "g"), "id")
    assert all(want[r.g] == r[2] for r in dealt.groupBy("perm", "g").sum("y").collect())


def metrics_by_loop(matrix):
    def lines(sequences):
        out = []
        for row in sequences:
            run = 0
            for cell in [*row, 0]:
                if cell:
                    run += 1
                elif run:
                    out.append(run)
                    run = 0
        return [n for n in out if n >= 2]

    n, total = len(matrix), matrix.sum()
    diagonal = lines([np.diagonal(matrix, k) for k in range(-n + 1, n)])
    column = lines(list(matrix.T))
    return total / (n * (n - 1)), sum(diagonal) / total, max(diagonal), sum(column) / total, max(column)


def test_recurrence_lines_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    matrix = (rng.random((12, 12)) < 0.4).astype(int)
    np.fill_diagonal(matrix, 0)
    edges = spark.createDataFrame([(1, int(i), int(j)) for i, j in zip(*np.nonzero(matrix), strict=True)], "k int, i int, j int")
    found = one(ts.line_metrics(edges, spark.createDataFrame([(1, 132)], "k int, cells long"), ["k"]))
    assert (found.rr, found.det, found.max_diag, found.lam, found.max_vert) == pytest.approx(metrics_by_loop(matrix), abs=1e-6)


def test_identical_series_transfer_nothing(spark):
    rows = spark.createDataFrame([(0, k, float(k * 7 % 11), float(k * 7 % 11)) for k in range(50)], "g int, i int, a double, b double")
    assert abs(one(ts.transfer_entropy(rows, ["g"], "a", "b", "te")).te) < 1e-9


def test_dfa_of_noise(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(0, k, float(v), 3000) for k, v in enumerate(rng.normal(size=3000))], "g int, i int, v double, n long")
    # scales as short as 4 bend the exponent up
    assert 0.5 < one(ts.dfa_alpha(rows, ["g"])).alpha1 < 0.7


def test_welch_finds_a_sine():
    t = np.arange(0, 300, 0.25)
    f, p = grouped.welch(np.sin(2 * np.pi * 0.1 * t), 4.0, 240)
    assert abs(f[np.argmax(p)] - 0.1) < 0.02
    assert grouped.area_under(p, f) == pytest.approx(0.5, rel=0.05)


def test_spline_repeats_cubics():
    x = np.array([0.0, 1.0, 2.5, 3.0, 5.0, 6.0])
    cubic = lambda v: v**3 - 2 * v**2 + v - 1
    at = np.linspace(0, 6, 31)
    assert np.allclose(grouped.cubic_spline(x, cubic(x), at), cubic(at))


def test_hull_and_raster():
    assert grouped.hull_area(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]], float)) == 4.0
    assert grouped.hull_area(np.array([[0, 0], [1, 1], [2, 2]], float)) == 0.0
    drawn = grouped.raster([("draw", 1.0, np.array([[1, 1], [4, 1]], float))], 8, 8)
    assert drawn.sum() == 4
    assert grouped.raster([("draw", 1.0, np.array([[1, 1], [4, 1]], float)), ("erase", 1.0, np.array([[2, 1], [3, 1]], float))], 8, 8).sum() == 2


def test_folds_never_split_a_group():
    folds = learn.group_folds({k: 1 + k % 5 for k in range(23)}, 5, 3)
    load = [sum(1 + k % 5 for k in folds if folds[k] == f) for f in range(5)]
    assert set(folds) == set(range(23)) and max(load) - min(load) <= 5


def test_pruning_skips_copies():
    rng = np.random.default_rng(1)
    y = np.arange(100) % 2
    x = rng.normal(size=(100, 6))
    x[:, 0] += 2 * y
    x[:, 1] = x[:, 0] * 3
    assert learn.f_test_prune(x, y, 3)[0] in (0, 1) and not {0, 1} <= set(learn.f_test_prune(x, y, 3))
    assert learn.f_test_prune(x, y, 6) == list(range(6))


def test_cross_validation_learns_and_skips_single_class(spark):
    rng = np.random.default_rng(2)
    data = [(k, k % 10, k % 2 if k % 7 else None, [float(v) for v in rng.normal(size=5) + 2 * (k % 2)]) for k in range(200)]
    df = spark.createDataFrame(data, "id long, g long, y int, x array<double>")
    folds = learn.fold_table(spark, df, "g", 5, [0])
    found = learn.cross_validate(df, folds, "g", "id", "x", "y")
    assert found.count() == sum(1 for d in data if d[2] is not None)
    assert one(st.roc_auc(found, "p", "label")).auc > 0.9
    assert learn.cross_validate(df.where("y = 1"), folds, "g", "id", "x", "y").count() == 0


def test_archive_and_bounds(spark, tmp_path):
    events = [{"t": 5, "type": "other", "role": "d", "payload": {}}, {"t": 9, "type": "draw_stroke", "payload": {}}, {"t": 30, "type": "trial_final_time", "payload": {}}, {"t": 20, "type": "sync_flash", "payload": {"flashTs": 21}}]
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as archive:
        archive.writestr("trials/T01/events.json", json.dumps(events))
    found = files.archive_events(files.archive_members(spark, str(tmp_path / "s.zip")))
    assert tuple(one(files.trial_bounds(found, ["member"]).select("start", "end"))) == (9, 30)
    assert one(files.flashes(found)).flash == 21
    assert one(files.first_payload(found, "draw_stroke", ["member"])).t == 9


def test_tracker_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# Unix time: 100.5\n#DATA\ntimestamp,gaze_x,gaze_y,interp_x,interp_y\n10,1,2,9,9\n20,,2,7,8\n")
    raw = files.read_headed(spark, str(tmp_path / "a.csv"), ["timestamp", "gaze_x", "gaze_y", "interp_x", "interp_y"])
    assert sorted(map(tuple, files.aurora_gaze(raw).collect())) == [(100510, 1.0, 2.0), (100520, 7.0, 8.0)]
    lines = spark.createDataFrame([("t,x,bpm",), ("100,0,70.5,rest",), ("101,0,bad",), ("1.5,0,3",)], "value string")
    assert sorted(map(tuple, files.heart_rate(lines).collect())) == [(100, 70.5, "rest"), (101, None, None)]


def test_labels_of_gaze(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# Unix time: 100\n#DATA\ntimestamp,gaze_x,gaze_y,interp_x,interp_y,eyelid_left,eyelid_right\n10,650,30,,,0.1,0.1\n20,,,,,0.9,0.9\n30,700,400,,,0.9,0.1\n")
    raw = files.read_headed(spark, str(tmp_path / "a.csv"), ["timestamp", "gaze_x", "gaze_y", "interp_x", "interp_y", "eyelid_left", "eyelid_right"])
    bounds = spark.createDataFrame([("T02", 100010, 100020), ("T01", 100010, 100010), ("T03", 100030, 100090)], "label string, start long, end long")
    found = files.labelled(files.aurora_samples(raw), bounds, "director").orderBy("t").collect()
    assert [(r.t, r.trial, r.aoi, r.blink) for r in found] == [(100010, "T01", "timer", 1), (100020, "T02", "missing", 1), (100030, "T03", "map", 0)]


def test_screen_tracker(spark):
    raw = spark.createDataFrame(
        [("132223104000000000", "s1", "1", "2", "9", "9", "0.003"), ("132223104000010000", "s1", "0", "0", "5", "6", "3.1"), ("132223104000020000", "s2", "1", "1", "1", "1", None), ("", "s1", "1", "1", "1", "1", None)],
        "RealTimeClock string, screen string, filtered_x string, filtered_y string, raw_x string, raw_y string, pupil string",
    )
    found = sorted(map(tuple, files.screen_gaze(raw, "s1").collect()))
    assert found == [(1577836800000, 1.0, 2.0, 3.0), (1577836800001, 5.0, 6.0, 3.1)]
    assert files.screen_gaze(raw).count() == 3


def test_gaze_tables_and_routes(spark, tmp_path):
    names = [c.split()[0] for c in files.GAZE.split(", ")]
    for k in (1, 2):
        row = {"t_unix_ms": "5", "trial": f"T0{k}", "gaze_x": "1.5"}
        (tmp_path / f"g{k}.csv").write_text(",".join(names) + "\n" + ",".join(row.get(n, "") for n in names) + "\n")
    assert sorted((r.trial, r.gaze_x, r.file[-6:]) for r in files.gaze_tables(spark, f"{tmp_path}/*.csv").collect()) == [("T01", 1.5, "g1.csv"), ("T02", 1.5, "g2.csv")]
    assert [r.trial for r in files.gaze_tables(spark, f"{tmp_path}/*.csv", "T02").collect()] == ["T02"]
    (tmp_path / "gt_3.json").write_text(json.dumps({"image": {"width": 651, "height": 900}, "strokes": [{"points": [{"x": 1, "y": 2}, {"x": 3, "y": None}]}, {"polyline": [{"x": 5, "y": 6}]}]}, indent=1))
    assert sorted(map(tuple, files.routes(spark, str(tmp_path)).collect())) == [(3, 0, 1.0, 2.0, 651, 900), (3, 1, 5.0, 6.0, 651, 900)]


def test_baselines_and_session_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as archive:
        archive.writestr("session/hr_baseline.json", json.dumps({"director": 71.5, "matcher": "80"}))
    found = one(files.heart_rate_baselines(files.archive_members(spark, str(tmp_path / "s.zip"))))
    assert (found.director, found.matcher) == (71.5, None)
    tables = {"hr": spark.createDataFrame([("a", 1), ("b", 2)], "session string, v int"), "gaze": spark.createDataFrame([("a", 3.0)], "session string, w double")}
    files.write_session_tables(tables, str(tmp_path / "out"))
    files.write_session_tables({"hr": tables["hr"].where("session = 'b'").withColumn("v", F.lit(9))}, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/hr").select("session", "v").collect())) == [("a", 1), ("b", 9)]
    files.write_union([spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("b", None, 2)], "k string, v int, w int")], str(tmp_path / "union"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/union").collect())) == [("a", "1", None), ("b", None, "2")]


def test_masks():
    rng = np.random.default_rng(4)
    for _ in range(20):
        mask, other = rng.random((7, 9)) < 0.2, rng.random((7, 9)) < 0.3
        places = np.argwhere(mask)
        found = grouped.distance_transform(mask)
        for y in range(7):
            for x in range(9):
                want = np.sqrt(((places - (y, x)) ** 2).sum(axis=1)).min() if len(places) else np.inf
                assert found[y, x] == pytest.approx(want)
                around = mask[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
                assert grouped.boundary_of(mask)[y, x] == (mask[y, x] and (y in (0, 6) or x in (0, 8) or not around.all()))
        assert grouped.global_ssim(mask, mask) == pytest.approx(1.0) and grouped.global_ssim(mask, other) < 1
        agreed = grouped.mask_agreement(mask, mask)
        assert not mask.any() or (agreed["iou"], agreed["f1"], agreed["chamfer"], agreed["boundary_f"]) == (1.0, 1.0, 0.0, 1.0)
        assert grouped.mask_agreement(mask, np.zeros_like(mask))["boundary_f"] == 0.0


def test_kendall_equals_pairs():
    rng = np.random.default_rng(7)
    for n in (2, 5, 40):
        x, t = rng.integers(0, 6, n).astype(float), rng.integers(0, 9, n).astype(float)
        s = sum(np.sign(x[a] - x[b]) * np.sign(t[a] - t[b]) for a in range(n) for b in range(a))
        nx, nt = (sum(v[a] != v[b] for a in range(n) for b in range(a)) for v in (x, t))
        want = s / np.sqrt(nx * nt) if nx and nt else None
        assert grouped.kendall_tau(x, t) == (pytest.approx(want) if want is not None else None)
    assert grouped.kendall_tau(np.ones(4), np.arange(4.0)) is None


def test_pupil_power_of_a_slow_wave():
    t = np.arange(0, 120_000, 50.0)
    slow, fast = np.sin(2 * np.pi * 0.1 * t / 1000), np.sin(2 * np.pi * 2 * t / 1000)
    assert grouped.pupil_power(t, slow) > 100 * grouped.pupil_power(t, fast) and grouped.pupil_power(t[:30], slow[:30]) is None
    bands = grouped.hrv_bands(800 + 50 * np.sin(np.arange(300) * 0.5))
    assert bands["total"] == pytest.approx(bands["vlf"] + bands["lf"] + bands["hf"]) and bands["lf_nu"] + bands["hf_nu"] == pytest.approx(100)


def test_learners_tell_two_clouds_apart():
    rng = np.random.default_rng(3)
    y = np.arange(240) % 2
    x = rng.normal(size=(240, 6)) + 1.2 * y[:, None]
    ring = rng.normal(size=(240, 6))
    round_ = (np.linalg.norm(ring[:, :2], axis=1) > 1.18).astype(int)
    for name, learner in learn.LEARNERS.items():
        p = learner(x[:160], y[:160], x[160:])
        assert ((p > 0.5) == y[160:]).mean() > 0.85, name
        if name in ("forest", "extra_trees", "kernel", "perceptron"):
            assert ((learner(ring[:160], round_[:160], ring[160:]) > 0.5) == round_[160:]).mean() > 0.6, name
    assert ((learn.stacked(x[:160], y[:160], x[160:], passthrough=True) > 0.5) == y[160:]).mean() > 0.85


def test_p_values(spark):
    found = spark.createDataFrame([(0.0,), (1.959964,), (-2.575829,), (3.3,), (None,)], "z double").select(st.two_sided_p(F.col("z")).alias("p")).withColumn("s", st.stars(F.col("p"))).collect()
    assert [r.p if r.p is None else pytest.approx(r.p, abs=1e-6) for r in found] == [1.0, 0.05, 0.01, 0.000967, None]
    assert [r.s for r in found][2:4] == ["*", "***"] or [r.s for r in found][3] == "***"


def test_nearest_other_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    data = [(k, k % 3, float(x), float(y)) for k, (x, y) in enumerate(np.round(rng.normal(size=(150, 2)) ** 3, 2))] + [(900, 7, 1.0, 1.0), (901, 8, 2.0, 2.0), (902, 8, 2.0, 5.0)]
    points = spark.createDataFrame(data, "id long, k long, x double, y double")
    want = {i: min((np.hypot(x - u, y - v) for j, c, u, v in data if c == k and j != i), default=None) for i, k, x, y in data}
    found = {r.id: r.d for r in joins.nearest_other(points, ["k"], "id").collect()}
    assert found == {i: pytest.approx(d) for i, d in want.items() if d is not None}


def test_silhouette_blocks(spark, monkeypatch):
    monkeypatch.setattr(grouped, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(60, 3)), np.arange(60) % 3
    rows = spark.createDataFrame([(k, int(c[k]), x[k].tolist()) for k in range(60)], "id long, c int, v array<double>")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for r in grouped.silhouettes(rows, "id", "c", "v").collect():
        own, others = [k for k in range(60) if c[k] == r.c and k != r.id], [[k for k in range(60) if c[k] == o] for o in range(3) if o != r.c]
        assert (r.a, r.b) == (pytest.approx(far[r.id, own].mean()), pytest.approx(min(far[r.id, o].mean() for o in others)))


def test_markers(spark):
    rows = spark.createDataFrame([("{bad",), ('{"type": "ping"}',), ('{"type": "flash"}',), ('{"type": "flash", "trial": "3", "flashTs": 7, "sessionId": "s"}',)], "value string")
    assert sorted(map(tuple, markers.decode(markers.encode(rows)).select("value", "trial", "flash_ms", "session").collect())) == [("flash|3|7|s", "3", 7.0, "s"), ("flash|?|0|", "?", 0.0, "")]


def test_sliding_stream_equals_batch(spark):
    stream = markers.event_stream(spark, "/root/testdata/sf0.001")
    found = markers.run_to_table(markers.sliding_mean(stream), "complete")
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = batch.groupBy("event_type", F.window("ts", "2 days", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
    assert sorted(map(tuple, found.select("event_type", "start", "n").collect())) == sorted(map(tuple, want.collect()))


def test_accuracy_steps_by_batches(spark):
    """Drawings cut by a batch's end, one without a key; each stroke is drawn once."""
    rng = np.random.default_rng(2)
    rows = [(d, s, "erase" if s == 2 else "draw", 3 * s + i, *map(float, rng.uniform(0, 20, 2))) for d in (0, 1, 2, None) for s in range(5) for i in range(3)]
    strokes = spark.createDataFrame(rows, "dyad long, stroke int, mode string, i int, x double, y double")
    line = spark.createDataFrame([(0, 2.0, 3.0), (1, 15.0, 12.0)], "place int, x double, y double")
    truth = grouped.raster([("draw", 3.0, np.array([[2, 3], [15, 12]], float))], 20, 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = {(r.dyad, r.strokes): r for r in grouped.accuracy_steps(strokes, line, ["dyad"], "dyad long", 20, 20, (3.0, 5.0), 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 12
    for (dyad, n), row in found.items():
        parts = [("erase", 5.0, p) if s == 2 else ("draw", 3.0, p) for s in range(n) for p in [np.array([r[4:] for r in rows if r[:2] == (dyad, s)])]]
        mask = grouped.raster(parts, 20, 20)
        assert row.coverage == pytest.approx(mask.mean()) and row.iou == pytest.approx((truth & mask).sum() / (truth | mask).sum(), abs=1e-6)
        assert np.allclose(grouped.distances_at(mask, np.nonzero(truth)), grouped.distance_transform(mask)[truth])


def test_stability_by_classes(spark):
    """Three thousand items of five profiles: shares by pairs of classes, all pairs of items beside them."""
    rng = np.random.default_rng(4)
    kinds = rng.integers(0, 3, (5, 4))
    rows = [(seed, item, int(kinds[item % 5, seed])) for item in range(3000) for seed in range(4) if (item % 5, seed) != (4, 1)]
    labels = spark.createDataFrame(rows, "seed int, item long, cluster long")
    classes = st.profiles(labels, "seed", "item", "cluster")
    assert st.met_classes(labels, classes, "seed", "item", "cluster").count() <= 15
    few = labels.where("item < 60")
    shares = st.co_assignment(few, "seed", "item", "cluster")
    want = {}
    for s, i, c in [r for r in rows if r[1] < 60]:
        for t, j, d in [r for r in rows if r[1] < 60]:
            if s == t and c == d and i < j:
                want[i, j] = want.get((i, j), 0) + 1
    assert {(r.a, r.b): r.share for r in shares.collect()} == {k: v / 4 for k, v in want.items()}
    for seed in (0, 1):
        plain = st.stability(shares, few.where(F.col("seed") == seed).select("item", "cluster")).first()
        assert st.class_stability(few, "seed", "item", "cluster", seed).first() == plain


def test_clusterings_share_their_distances(spark, monkeypatch):
    """Two clusterings in one pass, each pair of blocks once; copies have no distance."""
    monkeypatch.setattr(grouped, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 5)) + 1000
    x[7] = x[3]
    c = np.column_stack([np.arange(50) % 2, rng.integers(0, 3, 50)])
    rows = spark.createDataFrame([(i, int(a), int(b), v.tolist()) for i, ((a, b), v) in enumerate(zip(c, x, strict=True))], "id long, c int, d int, v array<double>")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(grouped.euclidean(x, x), far, rtol=1e-6, atol=0) and grouped.euclidean(x, x)[3, 7] == 0
    found = grouped.clusterings(rows, "id", ["c", "d"], "v").collect()
    assert len(found) == 100
    for r in found:
        own = c[:, r["_which"]]
        means = {k: far[r.id, (own == k) & (np.arange(50) != r.id)].mean() for k in set(own.tolist())}
        assert r["_own"] == own[r.id] and r.a == pytest.approx(means.pop(own[r.id]), rel=1e-6) and r.b == pytest.approx(min(means.values()), rel=1e-6)


def test_permuted_scores_equal_the_plain_way(spark, monkeypatch):
    """Scores by products are those of centroid_scores over labels dealt in long form."""
    monkeypatch.setattr(learn, "PERMS_A_TASK", 3)
    rng = np.random.default_rng(8)
    rows = [(i, i % 7, int(rng.integers(0, 2)), i % 7 % 3, [*rng.normal(size=3).tolist(), 1.0, None if i == 5 else float(i)]) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, g long, label int, fold int, v array<double>")
    dealt = st.shuffled_within(table.select("id", "g", "label"), "g", "id", "label", 8, 7).unionByName(table.select(F.lit(-1).alias("perm"), "id", "label"))
    plain = table.drop("label").select("id", "fold", F.posexplode("v").alias("feature", "v")).join(dealt, "id")
    want = {(r.perm, r.id): (r.label, r.score) for r in learn.centroid_scores(plain, ["perm"], "id").collect()}
    found = {(r.perm, r.id): (r.label, r.score) for r in learn.permuted_scores(table, "id", "g", "v", "label", "fold", 8, 7).collect()}
    assert found.keys() == want.keys() and len(want) == 540
    assert all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)


def test_nearest_columns_and_stumps_without_sorts():
    """Ties go to the first column; the partition finds what a stable sort finds."""
    rng = np.random.default_rng(9)
    for d in (rng.normal(size=(30, 50)), rng.integers(0, 4, (30, 50)).astype(float)):
        for k in (1, 11, 50):
            assert (learn.nearest_columns(d, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()


def test_kernel_holds_one_matrix():
    """The margins of the bordered system solved whole, in memory for one matrix and strips."""
    rng = np.random.default_rng(10)
    x, new = rng.normal(size=(2100, 5)), rng.normal(size=(700, 5))
    y = (x[:, 0] * x[:, 1] + rng.normal(size=2100) / 4 > 0).astype(float)
    tracemalloc.start()
    found = learn.kernel_margin(x, y, new)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.2 * 8 * 2100**2
    scale = 1 / (5 * x.var())
    kernel = lambda a: np.exp(-scale * ((a[:, None] - x[None]) ** 2).sum(axis=2))
    border = np.block([[np.zeros((1, 1)), np.ones((1, 2100))], [np.ones((2100, 1)), kernel(x) + np.eye(2100)]])
    inverse = np.linalg.inv(border)
    solved = inverse @ np.r_[0.0, 2 * y - 1]
    left_out = 2 * y - 1 - solved[1:] / np.diag(inverse)[1:]
    assert np.allclose(found, learn.logistic(left_out[:, None], y, (kernel(new) @ solved[1:] + solved[0])[:, None]), atol=1e-8)


def test_kernel_by_tiles_on_disk(monkeypatch, tmp_path):
    """With tiles in a file the margins stay, memory is far from rows by rows, and no file is left."""
    rng = np.random.default_rng(11)
    x, new = rng.normal(size=(2100, 5)), rng.normal(size=(70, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    want = learn.kernel_margin(x, y, new)
    monkeypatch.setattr(learn, "HELD", 0, raising=False)
    monkeypatch.setattr(learn, "COLUMN", 8 * 2100 * 130, raising=False)
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    tracemalloc.start()
    found = learn.kernel_margin(x, y, new)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.3 * 8 * 2100**2 and not list(tmp_path.iterdir())
    assert np.allclose(found, want, atol=1e-12)
    a = rng.normal(size=(300, 300))
    a, known = a @ a.T + np.eye(300), rng.normal(size=(300, 2))
    for width in (17, 128, 512):
        monkeypatch.setattr(learn, "STRIP", width)
        monkeypatch.setattr(learn, "COLUMN", 1 << 30)
        solved, diagonal = learn.inverse_parts(lambda i, j: a[i, j].copy(), 300, known)
        assert np.allclose(solved, np.linalg.solve(a, known)) and np.allclose(diagonal, np.linalg.inv(a).diagonal())
