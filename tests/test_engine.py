"""Closed forms, properties, errors and plans of the gridded engine."""

from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica import catalog
from lattica.functions import geo, timeaxis
from lattica.operators import align, grid, spectral, stats, verify
from lattica.plans import views
from lattica.sources import base, files, providers, remote
from lattica.spec import DataSource, Experiment, Leadtime, Region, Role, Selection, TimeRange, Variable


def fields(spark, f, h=4, w=5, times=1):
    rows = [(t, y, x, float(f(y, x, t))) for t in range(times) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "t int, y int, x int, v double")


def as_array(df, h, w, value="v"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = np.nan if r[value] is None else r[value]
    return out


def test_affine_field_is_exact(spark):
    df = fields(spark, lambda y, x, t: 3 * y - 2 * x + 1)
    got = as_array(grid.regrid(df, (4, 0.0, 1.0), (5, 0.0, 1.0), [0.5, 1.25, 3.0], [0.0, 3.75], ["t"], ["v"]), 3, 2)
    assert np.allclose(got, [[3 * y - 2 * x + 1 for x in (0, 3.75)] for y in (0.5, 1.25, 3)])


def test_outside_is_null_or_clamped(spark):
    df = fields(spark, lambda y, x, t: y)
    assert grid.regrid(df, (4, 0.0, 1.0), (5, 0.0, 1.0), [-1.0], [1.0], ["t"], ["v"]).count() == 0
    assert as_array(grid.regrid(df, (4, 0.0, 1.0), (5, 0.0, 1.0), [9.0], [1.0], ["t"], ["v"], "border"), 1, 1)[0, 0] == 3


def test_smoothing_keeps_a_constant_and_mirrors(spark):
    assert np.allclose(as_array(grid.smooth(fields(spark, lambda *_: 7), "v", 1.5, {"y": 4, "x": 5}, ["t"]), 4, 5), 7)
    field = np.random.default_rng(1).normal(size=(4, 5))
    got = as_array(grid.smooth(fields(spark, lambda y, x, t: field[y, x]), "v", 0.75, {"y": 4, "x": 5}, ["t"]), 4, 5)
    k = np.exp(-0.5 * (np.arange(-3, 4) / 0.75) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(field, [(3, 3) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        field = np.apply_along_axis(lambda r: np.convolve(r, k, "valid"), axis, padded)
    assert np.allclose(got, field)


def test_transform_matches_numpy(spark):
    field = np.random.default_rng(2).normal(size=(4, 6))
    df = fields(spark, lambda y, x, t: field[y, x], 4, 6)
    c = spectral.rfft2(df, 4, 6, ["t"], ["v"]).collect()
    want = np.fft.rfft2(field)
    assert len(c) == 16 and all(abs(r["re_v"] + 1j * r["im_v"] - want[r["ky"], r["kx"]]) < 1e-9 for r in c)


def test_welch_of_a_sine_peaks_at_its_frequency():
    freq, density = spectral.welch(np.sin(2 * np.pi * 0.1 * np.arange(400)))
    assert abs(freq[density.argmax()] - 0.1) < 1e-9 and len(freq) == 50


def test_radial_power_of_a_constant_is_nothing():
    centre, total, count = spectral.radial_power(np.ones((16, 16)), np.linspace(45, 40, 16), 0.1, 0.1, 8)
    assert np.allclose(total, 0) and (np.diff(centre) > 0).all() and count.sum() > 0


def test_rmse_splits_into_bias_and_spread(spark, sf):
    cells = verify.cell_metrics(verify.pair_models(views.grid_pair(spark, sf), "an", {"fc": "fc"}, ["y", "x"]), ["y", "x"])
    for r in cells.collect():
        assert abs(r["rmse"] ** 2 - r["bias"] ** 2 - r["stderr"] ** 2) < 1e-3


def test_metrics_of_missing_and_empty_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, None, 5.0), (2, None, 1.0)], "k int, a double, b double")
    got = {r["k"]: r for r in verify.cell_metrics(df, ["k"], ["mae", "r2"]).collect()}
    assert got[1]["mae"] == 1 and got[2]["mae"] is None and got[2]["r2"] == 1


def test_denormalised_is_nearly_what_it_was(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(50)], "variable string, value double")
    s = stats.channel_stats(df)
    got = sorted(r["value"] for r in stats.denormalise(stats.normalise(df, s), s).collect())
    assert np.allclose(got, range(50), atol=1e-4)


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_split_has_the_exact_size(spark, n):
    got = stats.split_exact(spark.range(n), "id", 0.9, 42)
    assert got.count() == n and got.where("train").count() == int(n * 0.9)


@settings(max_examples=25, deadline=None)
@given(st.floats(-720, 720), st.floats(-180, 180))
def test_wrapping_twice_is_wrapping_once(spark, lon, centre):
    once = geo.wrap(lon, centre)
    a, b = spark.range(1).select(once, geo.wrap(once, centre)).first()
    assert abs(a - b) < 1e-6 or abs(abs(a - b) - 360) < 1e-6
    assert centre - 180 - 1e-6 <= a <= centre + 180 + 1e-6


def test_spines(spark):
    months = [r["t"] for r in timeaxis.spine(spark, datetime(2020, 1, 15), datetime(2020, 4, 1), "MS").collect()]
    assert months == [datetime(2020, m, 1) for m in (2, 3, 4)]
    half_days = [r["t"] for r in timeaxis.spine(spark, datetime(2024, 5, 30), datetime(2024, 5, 31), "12h").collect()]
    assert max(half_days) == datetime(2024, 5, 31, 12) and len(half_days) == 4
    assert timeaxis.spine(spark, datetime(2024, 2, 2), datetime(2024, 2, 1), "D").count() == 0
    assert timeaxis.hours_of_day("6h") == ["00:00", "06:00", "12:00", "18:00"]
    for bad in (lambda: timeaxis.hours_of_day("5h"), lambda: timeaxis.spine(spark, datetime(2020, 1, 1), datetime(2020, 2, 1), "Q")):
        with pytest.raises(ValueError):
            bad()


def test_windows_and_chunks():
    windows = timeaxis.halved_windows(datetime(2019, 10, 11), datetime(2024, 12, 31), 3)
    assert [(b - a).days for a, b in windows] == [1908, 954, 477, 238, 119]
    assert timeaxis.split_at(windows[:1], datetime(2022, 1, 1))[0][1][0] == datetime(2022, 1, 2)
    chunks = timeaxis.request_chunks(datetime(2020, 2, 1), datetime(2021, 3, 1), 2, frozenset({"03"}))
    assert chunks[0] == {"year": 2020, "months": ["02", "04"]} and chunks[-1] == {"year": 2021, "months": ["01", "02"]}
    assert timeaxis.ensemble_size(3, 4 * 3 * 1, 3) == 4
    with pytest.raises(ValueError):
        timeaxis.ensemble_size(3, 13, 3)


def test_present_and_missing_make_the_spine(spark):
    spine = timeaxis.spine(spark, datetime(2020, 1, 1), datetime(2020, 1, 10), "D")
    some = spine.where(F.dayofmonth("t") % 3 == 0)
    assert align.missing(spine, some).count() + some.count() == spine.count()


def test_merge_rejects_conflicts(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    assert {r["k"]: r["v"] for r in align.merge(a, spark.createDataFrame([(2, 5.0)], "k int, v double"), ["k"]).collect()} == {1: 1.0, 2: 5.0}
    with pytest.raises(Exception, match="conflicting"):
        align.merge(a, spark.createDataFrame([(1, 2.0)], "k int, v double"), ["k"]).collect()


def test_ensembles_are_cut_to_the_smallest(spark):
    rows = [(d, m, True) for d, n in ((1, 3), (2, 2), (3, 3)) for m in range(10, 10 + n)]
    got = align.equal_members(spark.createDataFrame(rows, "t int, realization int, has_value boolean"))
    assert sorted({(r["t"], r["realization"]) for r in got.collect()}) == [(t, k) for t in (1, 2, 3) for k in (0, 1)]


def test_nearest_lead_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, 24.0), (1, 72.0)], "t int, lead double")
    assert align.nearest_lead(df, 48.0, ["t"]).first()["lead"] == 24.0


def test_specs():
    a = TimeRange(datetime(2020, 1, 1), datetime(2020, 2, 1))
    both = a + TimeRange(datetime(2021, 1, 1), datetime(2021, 2, 1))
    assert (both.start, both.end) == (datetime(2020, 1, 1), datetime(2021, 2, 1))
    with pytest.raises(ValueError):
        a + TimeRange(datetime(2021, 1, 1), datetime(2021, 2, 1), "MS")
    sel = Selection((Variable("t2m"),), catalog.REGIONS["conus"], a)
    assert sum([DataSource("x", sel), DataSource("y", sel)]).name == "x+y"
    with pytest.raises(ValueError):
        Experiment("e", (Role("input", ()),), ())
    assert catalog.variable("gh850_juno").levhpa == 850 and Variable("t2m").longname == "t2m"


def test_sources(spark, tmp_path):
    rows = [(datetime(2020, 1, d), 0, 0, 45.0, -130.0, float(d)) for d in (1, 2, 4)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, y int, x int, latitude double, longitude double, t2m double")
    sel = Selection((Variable("t2m"),), Region("r", (-180, 180), (90, -90)), TimeRange(datetime(2020, 1, 1), datetime(2020, 1, 5)))
    src = base.FrameSource(spark, DataSource("s", sel), lambda: df)
    assert set(src.load().columns) == {"t", "y", "x", "lat", "lon", "t2m"} and src.missed().count() == 2
    src.save(str(tmp_path / "store"))
    again = base.ParquetSource(spark, DataSource("s", sel), str(tmp_path / "store"))
    assert again.load().count() == 3
    assert (src + base.FrameSource(spark, DataSource("s2", sel), lambda: df)).load().count() == 3


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert base.canonical(df).where("v is null").count() == 2


def test_file_index(spark, tmp_path):
    for name in ("JLS0101000001010000", "JLS0102000001020100"):
        (tmp_path / name).write_text("x")
    spine = timeaxis.spine(spark, datetime(2020, 1, 1), datetime(2020, 1, 3), "D")
    found, missed = files.index(spine, files.listing(spark, str(tmp_path)), "JLS", "MMddHHmm", 0, True, None, 1, 1)
    assert sorted((r["t"].day, r["kind"]) for r in found.collect()) == [(1, 0), (2, 2)] and missed.count() == 1


def test_remote_source(spark):
    def fetch(request):
        for m in request["months"]:
            yield (request["year"], m)

    spark.dataSource.register(remote.remote_source("stub", "year int, month string", fetch))
    got = spark.read.format("stub").options(start="2020-01-01", end="2020-06-30", split_month="2", split_month_jump="03,04").load()
    assert sorted(r["month"] for r in got.collect()) == ["01", "02", "05", "06"]
    assert remote.area(catalog.REGIONS["conus"]) == [45, -130, 30, -90]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 1

    assert remote.with_retries(flaky, sleep=lambda s: None) == 1 and len(tries) == 3


def test_providers():
    spec = providers.build("ocean.juno.cmcc.hindcast.monthly", var_name="sos", leadtime_value=1, leadtime_unit="months", root_path="/archive/", realizations=3, engine="x")
    assert spec.params["file_suffix"].endswith("_r3i00p00.nc") and spec.params["engine"] == "x"
    with pytest.raises(KeyError):
        providers.build("nowhere")


def test_plans_push_filters_and_prune(spark, sf):
    df = views.table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz'1999-01-01 00:00:00'").select("l_suppkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_all_metrics_share_one_exchange(spark, sf):
    from lattica.plans.catalogue import pairs

    plan = verify.cell_metrics(pairs(spark, sf), ["model", "y", "x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the view's means, the metrics


def test_stream_equals_batch(spark, sf, tmp_path):
    from lattica.streaming.verification import windowed

    e = views.table(spark, sf, "events").select(F.col("ts").alias("t"), F.col("event_type").alias("variable"), F.col("value").alias("a"), F.lit(1.5).alias("b"))
    e.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("verified").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r["start"], r["variable"]): r["n"] for r in spark.table("verified").collect()}
    assert got == {(r["start"], r["variable"]): r["n"] for r in windowed(e).collect()}


def test_triangles_are_exact_for_affine_fields(spark, sf):
    from lattica.operators import curvilinear

    cells = views.grid_curv(spark, sf).withColumn("v", 2 * F.col("lat") - F.col("lon"))
    lat, lon = [44.0 - k for k in range(12)], [-128.0 + 2.0 * k for k in range(15)]
    weights = curvilinear.triangle_weights(cells.select("y", "x", "lat", "lon"), lat, lon)
    assert all(abs(r["s"] - 1) < 1e-9 for r in weights.groupBy("ty", "tx").agg(F.sum("w").alias("s")).collect())
    got = curvilinear.apply_weights(cells.select("y", "x", "v", F.lit(0).alias("t")), weights, ["t"], ["v"]).collect()
    assert len(got) > 100 and all(abs(r["v"] - (2 * lat[r["y"]] - lon[r["x"]])) < 1e-6 for r in got)


def test_grid_kinds(spark, sf):
    from lattica.operators import curvilinear

    curv, rect = views.grid_curv(spark, sf), views.grid_pair(spark, sf).select("y", "x", "lat", "lon").distinct()
    assert not curvilinear.is_rectilinear(curv) and curvilinear.is_rectilinear(rect)
    assert not curvilinear.is_regular(curv) and curvilinear.is_regular(curv, points=8)
    assert np.allclose(curvilinear.grid_resolution(rect), (2.0, 3.0))
    assert curvilinear.target_axes((-130, -129), (45, 44), 0.5) == ([45, 44.5, 44], [-130, -129.5, -129])


def test_experiment(spark, sf):
    from lattica.plans import experiment

    p = views.grid_pair(spark, sf)
    cut = F.expr("timestamp_ntz'1999-01-01 00:00:00'")
    both = experiment.pair(p.select("t", "y", "x", "fc"), p.select("t", "y", "x", "an"), "fc", "an", [p.where("y = 0 and x = 0 and an > 60000")])
    out, scores = experiment.run(both.where(F.col("t") < cut), both.where(F.col("t") >= cut), ["y", "x"], ["rmse"])
    assert scores.count() == 2 * 96 and experiment.loss("rmse", out) > 0
    assert experiment.combinations({"a": [1, 2], "b": {"c": [3, 4], "d": 5}})[3] == {"a": 2, "b": {"c": 4, "d": 5}}
    with pytest.raises(KeyError):
        experiment.rename(p, {"nothing": "x"})


def _globe(spark, convention):
    """Cells every 10 degrees on two levels, at two leads and three times; v tells the cell."""
    rows = []
    for day in (1, 2, 3):
        for level in (500, 850):
            for lead in (24, 48):
                for y, lat in enumerate(range(60, 20, -10)):
                    for x in range(36):
                        lon = 10.0 * x if convention == 360 else 10.0 * x - 180
                        rows.append((datetime(2024, 1, day), level, lead, y, x, float(lat), lon, float(level + lead), float(x)))
    return spark.createDataFrame(rows, "time timestamp_ntz, isobaricInhPa int, step int, y int, x int, latitude double, longitude double, u double, w double")


@pytest.mark.parametrize("convention", [180, 360])
@pytest.mark.parametrize("lon,want", [((-20, 30), {-20, -10, 0, 10, 20, 30}), ((170, -160), {170, -180, -170, -160}), ((350, 370), {-10, 0, 10}), ((-180, 180), set(range(-180, 180, 10)))])
def test_load_subsets_to_the_selection(spark, convention, lon, want):

    lead = Leadtime("lead", "days", 2)
    chosen = Selection((Variable("u", levhpa=850, leadtime=lead),), Region("r", lon, (30, 50)), TimeRange(datetime(2024, 1, 1), datetime(2024, 1, 2)))
    source = base.FrameSource(spark, DataSource("s", chosen), lambda: _globe(spark, convention))
    got = source.load().collect()
    assert {(r["lon"] + 180) % 360 - 180 for r in got} == want and {r["lat"] for r in got} == {30, 40, 50} and "w" not in got[0]
    assert {r["level"] for r in got} == {850} and {r["lead"] for r in got} == {48} and {r["u"] for r in got} == {898.0}
    assert len(got) == 2 * 3 * len(want) and {r["t"].day for r in got} == {1, 2}


def test_load_with_levels_of_its_own_for_each_variable(spark):

    chosen = Selection((Variable("u", levhpa=850), Variable("w", levhpa=500)), Region("r", (0, 20), (30, 50)), TimeRange(datetime(2024, 1, 1), datetime(2024, 1, 1)))
    got = base.FrameSource(spark, DataSource("s", chosen), lambda: _globe(spark, 360)).load().collect()
    assert all((r["u"] is None) == (r["level"] == 500) and (r["w"] is None) == (r["level"] == 850) for r in got) and len(got) == 2 * 2 * 3 * 3
    # one lead only: it is not asked for
    lone = Selection((Variable("u", leadtime=Leadtime("lead", "days", 9)),), chosen.region, chosen.period)
    assert base.FrameSource(spark, DataSource("s", lone), lambda: _globe(spark, 360).where("step = 24")).load().count() == 2 * 3 * 3


def test_cut_longitude_and_extremes(spark):

    cells = _globe(spark, 180).select(F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    assert tuple(grid.extremes(cells).first()) == (-180, 170, 30, 60)
    # the longitude before the nearest to the west bound; before the first comes the last
    assert [tuple(grid.cut_longitude(cells, w).first()) for w in (163.0, -21.0, -180.0)] == [(150, 33), (-30, 15), (170, 35)]


def test_regrid_any(spark):
    from lattica.operators import curvilinear

    cells = spark.createDataFrame([(y, x, 40.0 - 2 * y, 10.0 + 3 * x) for y in range(4) for x in range(5)], "y int, x int, lat double, lon double")
    df = cells.select(F.lit(1).alias("t"), "y", "x", (F.col("lat") + 10 * F.col("lon")).alias("v"))
    same = curvilinear.regrid_any(df, cells, [40, 38, 36, 34], [10, 13, 16, 19, 22], ["t"], ["v"])
    assert sorted(same.collect()) == sorted(df.collect())
    lat, lon = [41.0, 39.0, 33.0], [10.0, 11.5, 25.0]
    got = {(r["y"], r["x"]): r["v"] for r in curvilinear.regrid_any(df, cells, lat, lon, ["t"], ["v"], fill="nearest").collect()}
    want = {(y, x): (39.0 + 10 * lon[x] if y == 1 and x < 2 else min(max(lat[y], 34), 40) + 10 * min(lon[x], 22)) for y in range(3) for x in range(3)}
    # outside, and off the lines: the nearest cell; ties go to the first
    want |= {(0, 1): 40 + 100, (2, 1): 34 + 100, (1, 2): 40 + 220}
    assert got == pytest.approx(want)
    sheared = cells.withColumn("lat", F.col("lat") + 0.1 * F.col("x"))
    bent = sheared.select(F.lit(1).alias("t"), "y", "x", (F.col("lat") + 10 * F.col("lon")).alias("v"))
    got = {(r["y"], r["x"]): r["v"] for r in curvilinear.regrid_any(bent, sheared, [39.0, 90.0], [11.0, 12.0], ["t"], ["v"]).collect()}
    assert got[0, 0] == pytest.approx(149.0) and got[0, 1] == pytest.approx(159.0) and got[1, 0] is None and len(got) == 4


def test_smoothing_is_a_mirrored_gaussian(spark, tmp_path):
    rng = np.random.default_rng(1)
    field = rng.normal(size=(5, 7))
    df = fields(spark, lambda y, x, t: field[y, x] + t, 5, 7, 2)
    k = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    k /= k.sum()

    def line(v):
        n = len(v)
        mirror = np.concatenate([v, v[::-1]])
        return np.array([sum(k[i + 6] * mirror[(j + i) % (2 * n)] for i in range(-6, 7)) for j in range(n)])

    want = np.apply_along_axis(line, 1, np.apply_along_axis(line, 0, field))
    assert np.allclose(as_array(grid.smooth(df, "v", 1.5, {"y": 5, "x": 7}, ["t"]).where("t = 0"), 5, 7), want)
    dated = df.withColumn("t", F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, t)"))
    name, sigma = grid.smoothed_name("v", 100.0)
    back = grid.write_smoothed(dated, str(tmp_path / "smoothed"), "v", [100.0], {"y": 5, "x": 7}, ["t"])
    assert {"v", name} <= set(back.columns) and back.count() == 70


def test_statistics_and_predictions_come_back(spark, tmp_path):
    made = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "variable string, mean double, std double")
    assert sorted(stats.save_stats(made, str(tmp_path / "stats")).collect()) == sorted(made.collect())
    samples = spark.createDataFrame([(7, [float(k) for k in range(2 * 2 * 3)])], "sample int, value array<double>")
    cells = stats.unflatten(samples, ["sample"], ["u", "w"], 2, 3)
    assert {(r["y"], r["x"]): (r["u"], r["w"]) for r in cells.collect()} == {(y, x): (3.0 * y + x, 6 + 3.0 * y + x) for y in range(2) for x in range(3)}
    keys = spark.createDataFrame([(7, datetime(2021, 5, 1), 24)], "sample int, t timestamp_ntz, lead int")
    back = stats.save_predictions(cells, keys, str(tmp_path / "out"))
    assert back.count() == 6 and back.first()["lead"] == 24 and back.first()["year"] == 2021


def test_launchers_and_experiments(spark, sf):
    from lattica.plans import experiment
    from lattica.registry import EXPERIMENTS, LAUNCHERS, load_plugins

    assert "forecast-correction" in EXPERIMENTS.names() and load_plugins("lattica.none") == []
    p = views.grid_pair(spark, sf).select("t", "y", "x", F.col("fc").alias("b"), F.col("an").alias("a"))
    cut = F.expr("timestamp_ntz'1997-01-01 00:00:00'")

    def data(choice):
        scaled = experiment.transformed(p, lambda x, y: (x * choice["scale"], y * choice["scale"]))
        return scaled.where(F.col("t") < cut), scaled.where(F.col("t") >= cut)

    runs = LAUNCHERS["grid-search"]({"scale": [1, 2]}, data)
    assert [c for c, _ in runs] == [{"scale": 1}, {"scale": 2}]
    means = [m.where("model = 'raw'").agg(F.avg("rmse")).first()[0] for _, m in runs]
    assert means[1] == pytest.approx(2 * means[0])


def test_times(spark):
    row = spark.range(1).select(timeaxis.floor_day(F.expr("timestamp_ntz'2020-03-04 05:06:07'")).alias("d"), (F.expr("timestamp_ntz'2020-03-04'") + timeaxis.span(36, "hours")).alias("h")).first()
    assert row["d"] == datetime(2020, 3, 4) and row["h"] == datetime(2020, 3, 5, 12)
