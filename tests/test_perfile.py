"""Files read inside tasks, kept fetches, merges that find conflicts, exact quantiles by selection, samples."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import samples, stats
from lattica.plans import experiment
from lattica.sources import files, perfile
from lattica.sources.staged import Staged


def failing(request):
    """Fails until the marker is there, after a first frame."""
    yield pd.DataFrame({"v": [float(request["k"])]})
    if request["k"] == 2 and not os.path.exists(request["marker"]):
        raise OSError("lost")
    if request["k"] != 3:
        yield pd.DataFrame({"v": [request["k"] + 0.5]})


def nothing(request):
    if request["k"] == 1:
        return
    yield pd.DataFrame({"v": [1.0]})


def broken(request):
    yield pd.DataFrame({"v": [1.0]})
    raise KeyError("not foreseen")


def asked(spark, marker=""):
    return spark.createDataFrame([(f"r{k}", k, f"2020-01-0{k}", marker) for k in (1, 2, 3)], "request string, k int, t string, marker string")


def test_only_what_is_lacking_is_fetched_again(spark, tmp_path):
    marker = str(tmp_path / "marker")
    requests = asked(spark, marker)
    s = Staged(spark, str(tmp_path / "s"), failing, "v double", tries=2, base_sleep=0.0)
    assert s.rows().count() == 0 and s.lacking(requests).count() == 3
    s.run(requests)
    ledger = {r["request"]: r for r in s.ledger().collect()}
    assert {k: r["status"] for k, r in ledger.items()} == {"r1": "ok", "r2": "failed", "r3": "ok"}
    assert ledger["r2"]["error"] == "OSError: lost" and ledger["r2"]["try"] == 1 and ledger["r1"]["n_rows"] == 2
    assert sorted(r["v"] for r in s.rows().collect()) == [1.0, 1.5, 3.0]  # no row of the tries that failed halfway
    assert [r["t"] for r in s.missed(requests).collect()] == ["2020-01-02"]
    assert [r["request"] for r in s.lacking(requests).collect()] == ["r2"]
    open(marker, "w").close()
    s.run(requests, per_task=5).run(requests)
    assert sorted(r["v"] for r in s.rows().collect()) == [1.0, 1.5, 2.0, 2.5, 3.0]
    assert {r["attempt"] for r in s.ledger().collect()} == {0, 1} and s.missed(requests).count() == 0


def test_empty_requests_are_not_made_again_and_attempts_that_fail_do_not_count(spark, tmp_path):
    s = Staged(spark, str(tmp_path / "s"), nothing, "v double").run(asked(spark))
    assert {r["request"]: r["status"] for r in s.ledger().collect()} == {"r1": "empty", "r2": "ok", "r3": "ok"}
    assert s.lacking(asked(spark)).count() == 0 and [r["t"] for r in s.missed(asked(spark)).collect()] == ["2020-01-01"]
    b = Staged(spark, str(tmp_path / "b"), broken, "v double")
    with pytest.raises(Exception, match="not foreseen"):
        b.run(asked(spark))
    assert b.ledger().count() == 0 and b.rows().count() == 0


def archive(tmp_path):
    root = tmp_path / "archive"
    root.mkdir()
    cells = {"latitude": [1.0, 1.0, 1.0], "longitude": [5.0, 5.0, 5.0], "step": pd.to_timedelta([6, 12, 6], unit="h"), "v": [1.0, 2.0, 3.0], "w": [7, 8, 9]}
    pd.DataFrame(cells | {"valid_time": pd.to_datetime(["2020-02-01"] * 3), "extra": ["a", "b", "c"]}).to_parquet(root / "a 1.parquet")
    pd.DataFrame({"lat": [1.0], "lon": [5.0], "v": [4.0]}).to_parquet(root / "b.parquet")  # no time, no lead, no w
    pd.DataFrame({"lat": [1.0], "lon": [5.0], "other": [4.0]}).to_parquet(root / "c.parquet")
    (root / "d.parquet").write_bytes(b"not parquet")
    return str(root)


def listed(spark, root):
    day = F.when(F.col("name") < "c", "2020-01-01").when(F.col("name") < "d", "2020-01-02").otherwise("2020-01-03")
    return files.listing(spark, root).withColumn("t", day.cast("timestamp_ntz"))


def test_files_are_read_by_member_lead_and_step(spark, tmp_path):
    requests = perfile.numbered(listed(spark, archive(tmp_path)), ["path"])
    read = perfile.read_members(spark, requests, str(tmp_path / "out"), ["v", "w"], lead=7.0, step=lambda rows, request: rows.assign(v=rows["v"] * 10))
    got = sorted((str(r["t"])[:10], r["realization"], r["lead"], r["lat"], r["lon"], r["v"], r["w"]) for r in read.rows().collect())
    assert got == [("2020-01-01", 1, None, 1.0, 5.0, 40.0, None), ("2020-02-01", 0, 6.0, 1.0, 5.0, 10.0, 7.0), ("2020-02-01", 0, 6.0, 1.0, 5.0, 30.0, 9.0)]
    status = {r["request"].rsplit("/", 1)[1]: r["status"] for r in read.ledger().collect()}
    assert status == {"a 1.parquet": "ok", "b.parquet": "ok", "c.parquet": "empty", "d.parquet": "failed"}
    assert sorted(str(r["t"])[:10] for r in read.missed(requests).collect()) == ["2020-01-02", "2020-01-03"]
    assert [r["request"].rsplit("/", 1)[1] for r in read.lacking(requests).collect()] == ["d.parquet"]


def test_newest_file_is_the_first_member(spark, tmp_path):
    root = archive(tmp_path)
    os.utime(f"{root}/a 1.parquet", (1e9, 1e9))
    got = {r["request"].rsplit("/", 1)[1]: r["realization"] for r in perfile.numbered(listed(spark, root)).collect()}
    assert got == {"a 1.parquet": 1, "b.parquet": 0, "c.parquet": 0, "d.parquet": 0}


def test_csv_files_and_ties_of_leads(spark, tmp_path):
    root = tmp_path / "csv"
    root.mkdir()
    pd.DataFrame({"time": ["2020-01-01"] * 3, "lead": [12, 6, 12], "lat": 0.5, "lon": 1.5, "v": [1.5, 2.5, np.nan]}).to_csv(root / "a.csv", index=False)
    requests = perfile.numbered(files.listing(spark, str(root)).withColumn("t", F.lit("2020-01-01").cast("timestamp_ntz")))
    read = perfile.read_members(spark, requests, str(tmp_path / "out"), ["v"], lead=9.0, opener=perfile.CsvFile)
    assert sorted((r["lead"], r["v"]) for r in read.rows().where("v is not null and not isnan(v)").collect()) == [(12.0, 1.5)]
    assert read.rows().count() == 2


def test_merge_fills_nulls_and_raises_on_conflicts(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, None, 5.0), (None, 9.0, None)], "k int, v double, w double")
    b = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, None, "c"), (None, 9.0, "d")], "k int, v double, s string")
    got = {r["k"]: (r["v"], r["w"], r["s"]) for r in experiment.combine_variables([a, b, a], ["k"]).collect()}
    assert got == {1: (1.0, None, "a"), 2: (2.0, 5.0, "b"), 3: (None, None, "c"), None: (9.0, None, "d")}
    c = spark.createDataFrame([(1, 1.5), (3, 4.0)], "k int, v double")
    with pytest.raises(Exception, match="conflicting values of v"):
        experiment.combine_variables([a, b, c], ["k"]).collect()
    assert [tuple(r) for r in experiment.conflicts([a, b.drop("s"), c], ["k"]).collect()] == [(1, "v", 1.0, 1.5)]
    assert experiment.combine_variables([a.limit(0), b.limit(0)], ["k"]).count() == 0


@pytest.mark.parametrize("bins", [2, 3, 64])
def test_selection_equals_numpy(spark, bins):
    rng = np.random.default_rng(1)
    channels = {"a": rng.normal(size=500), "b": np.repeat([1.0, 2.0, 1e12], [5, 300, 1]), "c": np.array([-3.5]), "d": np.array([0.0, 5e-324])}
    rows = [(k, float(x)) for k, xs in channels.items() for x in xs] + [("a", None), ("a", float("nan")), ("e", None)]
    qs = [0.0, 0.01, 0.25, 0.5, 0.997, 1.0]
    got = stats.quantiles_by_selection(spark.createDataFrame(rows, "c string, value double"), "c", "value", qs, bins)
    got = {(r["c"], r["q"]): r["value"] for r in got.collect()}
    assert got.keys() == {(c, q) for c in channels for q in qs}
    for (c, q), x in got.items():
        assert np.isclose(x, np.quantile(channels[c], q), rtol=1e-12, atol=1e-12), (c, q)


def test_selection_of_values_that_differ_between_scans(spark):
    """As means do in their last bits, where shuffled parts arrive in another order."""
    shaken = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    rows = spark.range(500, numPartitions=3).select(F.lit("a").alias("c"), shaken(F.col("id").cast("double")).alias("value"))
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["q"]: r["value"] for r in stats.quantiles_by_selection(rows, "c", "value", qs, 8).collect()}
    assert got.keys() == set(qs)
    for q, x in got.items():
        assert x is not None and np.isclose(x, np.quantile(np.arange(500.0), q), atol=1e-6), q


def test_selection_of_nothing(spark):
    assert stats.quantiles_by_selection(spark.createDataFrame([], "c string, value double"), "c", "value", [0.5]).count() == 0


def test_samples_have_masks(spark):
    cells = [("s", 0, 0, 1.0, 2.0), ("s", 1, 2, None, 3.0), ("s", 0, 1, float("nan"), None), ("u", 1, 0, 4.0, 5.0)]
    packed = samples.pack(spark.createDataFrame(cells, "k string, y int, x int, b double, a double"), ["k"], ["b", "a"], ["a"], 2, 3)
    got = {r["k"]: r for r in packed.collect()}
    assert got["s"]["x"] == [1, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 3] and got["s"]["y"] == [2, 0, 0, 0, 0, 3]
    assert got["s"]["x_mask"] == [True] + [False] * 5 + [True] + [False] * 4 + [True] and got["u"]["y_mask"] == [False] * 3 + [True] + [False] * 2
    means = {r["variable"]: (r["n"], r["mean"], r["std"]) for r in samples.masked_stats(packed, ["b", "a"]).collect()}
    assert means["b"] == (2, 2.5, 1.5) and means["a"][:2] == (3, pytest.approx(10 / 3))
    with pytest.raises(Exception, match="outside the grid"):
        samples.pack(spark.createDataFrame([("s", 2, 0, 1.0)], "k string, y int, x int, b double"), ["k"], ["b"], [], 2, 3).collect()


def test_order_of_samples_is_seeded(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))

    def dealt(seed, parts):
        return {r["k"]: (r["shard"], r["batch"], r["place"]) for r in samples.shuffled(df.repartition(parts), ["k"], seed, 4, 16).collect()}

    first = dealt(1, 3)
    assert first == dealt(1, 7) != dealt(2, 3)
    for shard in range(4):
        places = sorted(p for s, _, p in first.values() if s == shard)
        assert places == list(range(len(places))) and len(places) > 20
    assert all(b == p // 16 for _, b, p in first.values())
