"""Pendulum traces against an independent numpy evaluation of the same definitions."""

import json
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labspark.functions.regression import linear_fit, student_t_two_sided
from labspark.operators import pendulum as p
from labspark.operators.ordered import annotate, exact_median, into_blocks
from labspark.operators.roles import tracking_problems, tracking_samples
from labspark.plans.pendulum_run import analyse_tracking, evaluate_traces
from labspark.sources.lines import split_lines
from labspark.sources.tracking import read_tracking


@pytest.fixture(scope="module")
def trace(spark):
    t = F.col("row_idx") * 0.1
    theta, swing = F.radians(t * (11.0 / 3600)), F.cos(t * (2 * math.pi / 3.5)) * 50.0
    base = spark.range(12000).withColumnRenamed("id", "row_idx")
    return base.select(
        F.lit("P1").alias("dataset_id"),
        "row_idx",
        t.alias("t"),
        (F.cos(theta) * swing + 640).alias("x"),
        (F.sin(theta) * swing + 360).alias("y"),
        (F.lit(80.0) + F.col("row_idx") % 7).alias("area"),
    )


@pytest.mark.parametrize("block_rows", [1 << 20, 977])
def test_rotating_pendulum(trace, block_rows):
    run = evaluate_traces(trace, block_rows=block_rows)
    stats, rotation = run.period_stats.first(), run.rotation.first()
    assert stats.n_periods == 342
    assert math.isclose(stats.period_s, 3.499999999, rel_tol=1e-9)
    assert math.isclose(stats.length_m, 3.044004983, rel_tol=1e-9)
    extent = run.extent.first()
    assert math.isclose(extent.ax, 49.8993572, rel_tol=1e-8) and math.isclose(extent.ay, 3.1855687, rel_tol=1e-7)
    assert math.isclose(rotation.b_h, 10.9730613668, rel_tol=1e-9)
    assert math.isclose(rotation.b_h_error, 0.0010932365, rel_tol=1e-6)
    assert math.isclose(rotation.r2, 0.9999997221, rel_tol=1e-9)
    assert math.isclose(rotation.phi_exp, 46.8481243, rel_tol=1e-8)
    assert rotation.n_seg == 30 and rotation.seg_rows == 400
    sampling = run.sampling.first()
    assert sampling.n == 12000 and math.isclose(sampling.dt_s, 0.1, rel_tol=1e-9)
    assert sum(r.n for r in run.histogram.collect()) == 342
    assert run.coordinates.first().coords.startswith("(20.0,0.0603) (60.0,0.1819)")
    assert run.residuals.count() == 30


def test_published_angles(spark):
    angles = [2.3, 4.8, 7.1, 9.5, 11.8, 14.2, 16.5, 18.9, 21.2, 23.6]
    rows = [("P2", i, 1, 120.0 * (i + 1), a) for i, a in enumerate(angles)]
    segments = spark.createDataFrame(rows, "dataset_id string, seg int, seg_rows int, t_mid double, phi double")
    fit = p.rotation_fit(segments).first()
    assert math.isclose(fit.b_deg_s, 0.0196414141414, rel_tol=1e-10)
    assert math.isclose(fit.b_error, 4.1340166e-05, rel_tol=1e-7)
    assert math.isclose(fit.phi0_deg, 0.0266666667, rel_tol=1e-8)
    assert math.isclose(fit.phi0_error, 0.0307810778, rel_tol=1e-8)
    assert math.isclose(fit.s_y, 0.0450588840, rel_tol=1e-8)
    assert fit.phi_exp is None and fit.hinweis_phi.startswith("sin(phi)=4.7011>1")


def test_unwrap(spark):
    rows = [("P5", i, v) for i, v in enumerate([80.0, 88.0, -86.0, -79.0])]
    out = p.unwrap_angles(spark.createDataFrame(rows, "dataset_id string, seg int, phi double"))
    assert [r.phi for r in out.orderBy("seg").collect()] == [80, 88, 94, 101]


def test_unwrapped_steps_stay_small(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{s}", i, float(v)) for s in range(40) for i, v in enumerate(rng.uniform(-90, 90, 30))]
    raw = {(d, i): v for d, i, v in rows}
    out = p.unwrap_angles(spark.createDataFrame(rows, "dataset_id string, seg int, phi double")).collect()
    got = {(r.dataset_id, r.seg): r.phi for r in out}
    for (d, i), v in got.items():
        assert abs((v - raw[d, i]) / 180 - round((v - raw[d, i]) / 180)) < 1e-9
        if i:
            assert abs(v - got[d, i - 1]) <= 90 + 1e-9


def _brute(t, x, y, n_seg):
    """Direct evaluation with numpy, used only to check the tables."""
    xc = x - x.mean()
    i = np.where((xc[:-1] < 0) & (xc[1:] >= 0))[0]
    cross = t[i] - xc[i] / (xc[i + 1] - xc[i]) * (t[i + 1] - t[i])
    size = len(t) // n_seg
    phis = []
    for s in range(n_seg if size else 0):
        a, b = x[s * size : (s + 1) * size], y[s * size : (s + 1) * size]
        c = ((a - a.mean()) * (b - b.mean())).mean()
        phis.append(math.degrees(0.5 * math.atan2(2 * c, a.var(ddof=1) - b.var(ddof=1))))
    return np.diff(cross), phis


@pytest.mark.parametrize("block_rows", [7, 64, 1 << 20])
def test_random_traces_with_gaps_and_one_hot_trace(spark, block_rows):
    rng = np.random.default_rng(11)
    rows, arrays = [], {}
    for name, n in {"hot": 3000, "mid": 300, "tiny": 11, "one": 1}.items():
        idx = np.sort(rng.choice(n * 3, n, replace=False))
        t = np.cumsum(rng.uniform(0.05, 0.2, n))
        x, y = rng.normal(size=n).cumsum() * 0.3 + np.sin(t), rng.normal(size=n)
        arrays[name] = (t, x, y)
        rows += [(name, int(i), float(a), float(b), float(c), None) for i, a, b, c in zip(idx, t, x, y)]
    schema = "dataset_id string, row_idx long, t double, x double, y double, area double"
    samples = spark.createDataFrame(rows, schema).repartition(5)
    found = {}
    for r in p.periods(samples, block_rows=block_rows).orderBy("row_idx").collect():
        found.setdefault(r.dataset_id, []).append(r.period)
    segs = {}
    for r in p.segment_axis(samples, n_segments=4, block_rows=block_rows).orderBy("seg").collect():
        segs.setdefault(r.dataset_id, []).append(r.phi)
    sampling = {r.dataset_id: r for r in p.sampling_summary(samples, block_rows=block_rows).collect()}
    for name, (t, x, y) in arrays.items():
        periods, phis = _brute(t, x, y, 4) if len(t) > 1 else ([], [])
        np.testing.assert_allclose(found.get(name, []), periods, rtol=1e-9)
        np.testing.assert_allclose(segs.get(name, []), phis, rtol=1e-9)
        assert sampling[name].n == len(t)
        if len(t) > 1:
            assert math.isclose(sampling[name].dt_s, float(np.median(np.diff(t))), rel_tol=1e-12)
        else:
            assert sampling[name].dt_s is None
    assert p.segment_axis(samples, n_segments=30).filter("dataset_id = 'tiny'").count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from([0.1, 0.1, 0.2, -3.0, 5.5, 1e9, 0.0]) | st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_median_is_exact(spark, values):
    rows = [("k", i, float(v)) for i, v in enumerate(values)] + [("other", 0, 4.0)]
    df = spark.createDataFrame(rows, "dataset_id string, row_idx long, v double")
    got = exact_median(into_blocks(df, ["dataset_id"], block_rows=8), ["dataset_id"], "v", "m")
    by_key = {r.dataset_id: r.m for r in got.collect()}
    assert by_key["k"] == statistics.median(values) and by_key["other"] == 4.0


def test_median_of_many_values_orders_only_a_bracket(spark):
    df = spark.range(200_001).select(
        F.lit("k").alias("dataset_id"),
        F.col("id").alias("row_idx"),
        ((F.col("id") * 7919) % 200_001).cast("double").alias("v"),
    )
    got = exact_median(into_blocks(df, ["dataset_id"], block_rows=1000), ["dataset_id"], "v", "m")
    assert got.first().m == 100_000.0


def test_neighbours_cross_empty_blocks(spark):
    rows = [("k", i, float(i)) for i in (0, 1, 95, 96, 500)]
    blocked = into_blocks(
        spark.createDataFrame(rows, "dataset_id string, row_idx long, v double"), ["dataset_id"], block_rows=10
    )
    out = annotate(
        blocked,
        ["dataset_id"],
        previous={"before": "v"},
        following={"after": "v"},
        position="rn",
        totals={"total": F.col("v")},
    )
    got = [(r.before, r.after, r.rn, r.total) for r in out.orderBy("row_idx").collect()]
    assert got == [
        (None, 1.0, 0, 692.0),
        (0.0, 95.0, 1, 692.0),
        (1.0, 96.0, 2, 692.0),
        (95.0, 500.0, 3, 692.0),
        (96.0, None, 4, 692.0),
    ]


def test_rows_are_scanned_and_shuffled_once(trace, tmp_path):
    trace.write.parquet(str(tmp_path / "trace"))
    out = p.periods(trace.sparkSession.read.parquet(str(tmp_path / "trace")))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert len([line for line in shuffles if "ReusedExchange" not in line]) == 1
    assert plan.count("FileScan") == 1
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_tracking_files(spark):
    files = {
        "P": "# camera\n Zeit, X_pos ,y,Valid\n0,1,2,1 # first\n1,2,3,0\n2,3,4,1\n",
        "P3": "x,y\n1,2\n",
        "P4": "t\n1\n2\n4\n",
    }
    lines = split_lines(spark.createDataFrame(list(files.items()), "dataset_id string, content string"))
    layouts, rows = read_tracking(lines)
    samples = tracking_samples(rows)
    got = sorted((r.dataset_id, r.t, r.x, r.y) for r in samples.collect() if r.dataset_id == "P")
    assert got == [("P", 0.0, 1.0, 2.0), ("P", 2.0, 3.0, 4.0)]
    problems = {r.dataset_id: (r.error, r.hint) for r in tracking_problems(layouts).collect()}
    assert "Keine Zeitspalte" in problems["P3"][0] and "Nur Statistik" in problems["P4"][1]
    stats = {(r.dataset_id, r.channel): r for r in p.channel_stats(samples).collect()}
    assert stats["P4", "t"].n == 3 and ("P4", "x") not in stats


def test_tracking_files_to_results(spark):
    swing = "".join(f"{i / 10},{math.cos(i * 0.18):.6f},{math.sin(i * 0.18) / 9:.6f}\n" for i in range(400))
    files = {
        "good": "t,x,y\n" + swing,
        "infinite": "t,x,y\n" + swing + "41,inf,0\n",
        "long": "t,x,y\n1,2,3\n1,2,3,99\n",
        "no time": "x,y\n1,2\n",
        "no track": "t,area\n0,5\n1,7\n",
    }
    lines = split_lines(spark.createDataFrame(list(files.items()), "dataset_id string, content string"))
    rows = {r.dataset_id: r for r in analyse_tracking(lines).results.collect()}
    assert set(rows) == set(files)
    assert rows["long"].error and rows["long"].results is None and "Keine Zeitspalte" in rows["no time"].error
    good, infinite = json.loads(rows["good"].results), json.loads(rows["infinite"].results)
    assert rows["good"].error is None and rows["good"].columns == ["t", "x", "y"]
    assert good["periods"]["n_periods"] > 5 and good["periods"] == infinite["periods"]
    assert infinite["extent"]["ax"] == good["extent"]["ax"]
    assert len(good["segment_table"]["segments"]) == 30 and good["segment_s"] == 1.3 and good["phi_lit"] > 0
    assert [c["channel"] for c in good["channel_table"]["channels"]] == ["t", "x", "y"]
    partial = json.loads(rows["no track"].results)
    assert "Nur Statistik" in rows["no track"].hint and partial["sampling"]["n"] == 2
    assert {c["channel"] for c in partial["channel_table"]["channels"]} == {"area", "t"}


def test_rows_without_place_are_dropped_everywhere(spark):
    rows = [("a", i, float(i), 1.0 * (i % 5), 2.0, 1.0) for i in range(20)] + [("a", None, 99.0, 99.0, 99.0, 99.0), (None, 3, 1.0, 1.0, 1.0, 1.0)]
    samples = spark.createDataFrame(rows, "dataset_id string, row_idx long, t double, x double, y double, area double")
    assert p.unplaced_rows(samples).first().n_dropped == 2
    assert [r.n for r in p.sampling_summary(samples).collect()] == [20]
    assert {r.n for r in p.channel_stats(samples).collect()} == {20}
    assert p.trajectory_extent(samples).first().ax == 2.0 and p.tracking_quality(samples).first().area_mean == 1.0


@pytest.mark.parametrize("t", [0.0, 1e-6, 0.5, 1.5, 3.0, 40.0])
def test_p_value_has_no_border(t):
    at = student_t_two_sided.func
    for dof in (1e2, 1e4, 1e8, 1e12):
        low, high = at(pd.Series([t, t]), pd.Series([dof * (1 - 1e-9), dof * (1 + 1e-9)]))
        assert low >= high * (1 - 1e-12) and low - high <= 1e-6 * low + 1e-300
    one = 2 / math.pi * math.atan2(1, t)
    assert math.isclose(at(pd.Series([t]), pd.Series([1.0]))[0], one, rel_tol=1e-12)
    assert math.isclose(at(pd.Series([t]), pd.Series([1e18]))[0], math.erfc(t / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-300)


def test_p_values(spark):
    # two-sided Student t values with known closed forms: one and two degrees of freedom
    rows = [("one", float(x), y) for x, y in zip(range(3), [0.0, 1.0, 1.0])]
    rows += [("two", float(x), y) for x, y in zip(range(4), [0.0, 2.0, 1.0, 3.0])]
    rows += [("exact", 0.0, 1.0), ("exact", 1.0, 2.0), ("flat", 0.0, 1.0), ("flat", 1.0, 1.0)]
    rows += [("still", 1.0, 1.0), ("still", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    fits = {r.k: r for r in linear_fit(df, ["k"], "x", "y", p_value=True).collect()}
    r1, r2 = fits["one"].r_value, fits["two"].r_value
    t1, t2 = r1 / math.sqrt(1 - r1 * r1), r2 * math.sqrt(2 / (1 - r2 * r2))
    assert math.isclose(fits["one"].p_value, 1 - 2 / math.pi * math.atan(t1), rel_tol=1e-10)
    assert math.isclose(fits["two"].p_value, 1 - t2 / math.sqrt(t2 * t2 + 2), rel_tol=1e-10)
    assert fits["exact"].p_value == 0.0 and fits["exact"].slope_stderr == 0.0
    assert fits["flat"].p_value == 1.0 and fits["flat"].r_value == 0.0
    assert fits["still"].slope is None and fits["still"].p_value is None
