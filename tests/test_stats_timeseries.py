"""Statistics and rolling form against numpy/pandas brute force."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchside.operators import stats, timeseries

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.integers(0, 9, size=n).astype(float)})
    pdf["c"] = pdf["a"] * 2 + rng.normal(scale=0.1, size=n)
    return pdf, spark.createDataFrame(pdf)


def test_correlation_matches_numpy(table):
    pdf, df = table
    got = {(x.feature_x, x.feature_y): x.corr for x in stats.feature_correlation(df, COLS).collect()}
    want = np.corrcoef(pdf[COLS].to_numpy().T)
    for i, a in enumerate(COLS):
        for j, b in enumerate(COLS):
            assert got[(a, b)] == pytest.approx(want[i, j], abs=1e-12)


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1), (3.0, 0.1)], "a double, b double")
    got = {(x.feature_x, x.feature_y): x.corr for x in stats.feature_correlation(df, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and got[("b", "b")] is None and got[("a", "a")] == 1.0


def test_correlation_is_one_scan_and_stable_far_from_zero(spark):
    import contextlib
    import io
    rng = np.random.default_rng(9)
    x = rng.normal(size=5000)
    pdf = pd.DataFrame({"a": x + 1e9, "b": 0.5 * x + rng.normal(size=5000) - 1e9, "c": 0.1})
    df = spark.createDataFrame(pdf).repartition(7)
    found = stats.feature_correlation(df, ["a", "b", "c"])
    got = {(r.feature_x, r.feature_y): r.corr for r in found.collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef(pdf.a - 1e9, pdf.b + 1e9)[0, 1], abs=1e-7)   # the columns themselves hold 7 digits
    assert got["a", "c"] is None and got["c", "c"] is None and got["a", "a"] == 1.0
    path = tempfile.mkdtemp(prefix="pitchside-corr-") + "/t"
    df.write.parquet(path)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        stats.feature_correlation(spark.read.parquet(path), ["a", "b", "c"]).explain()
    assert text.getvalue().count("FileScan") == 1 and "Subquery" not in text.getvalue()


def test_histogram_matches_brute_force(table):
    pdf, df = table
    rows = stats.feature_histogram(df, COLS, bins=30).collect()
    assert len(rows) == 90
    for c in COLS:
        x = pdf[c].to_numpy()
        lo, hi = x.min(), x.max()
        bins = np.minimum(np.floor((x - lo) / (hi - lo) * 30), 29).astype(int)
        want = np.bincount(bins, minlength=30)
        got = [r["count"] for r in sorted((r for r in rows if r.feature == c), key=lambda r: r.bin)]
        assert got == list(want)
    labels = {r.feature: r.label for r in stats.feature_histogram(df, ["a"]).collect()}
    assert labels["a"] == "A"


def test_box_matches_numpy(table):
    pdf, df = table
    got = {r.feature: r for r in stats.feature_box(df, COLS).collect()}
    for c in COLS:
        x = pdf[c].to_numpy()
        q1, med, q3 = np.percentile(x, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = x[(x >= lo) & (x <= hi)]
        r = got[c]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3), abs=1e-12)
        assert (r.whisker_low, r.whisker_high) == (inside.min(), inside.max())
        assert r.n_outliers == int(((x < lo) | (x > hi)).sum())


def test_rolling_form_matches_pandas(spark):
    rng = np.random.default_rng(3)
    recs = [(int(p), int(w), int(rng.integers(0, 15))) for p in range(5) for w in range(1, 31) if rng.random() < 0.7]
    recs += [(0, 5, 4), (0, 5, 6)]          # duplicate (player, week) rows are summed
    pts = spark.createDataFrame(recs, "player_id long, week int, points long")
    got = timeseries.rolling_form(pts, 30).toPandas().sort_values(["player_id", "week"])
    raw = pd.DataFrame(recs, columns=["player_id", "week", "points"]).groupby(["player_id", "week"]).sum()
    for pid in range(5):
        s = raw.loc[pid]["points"].reindex(range(1, 31), fill_value=0).astype(float)
        g = got[got.player_id == pid]
        assert list(g.points) == list(s)
        np.testing.assert_allclose(g.ma_short.to_numpy(dtype=float), s.rolling(3).mean().to_numpy(), equal_nan=True)
        np.testing.assert_allclose(g.ma_long.to_numpy(dtype=float), s.rolling(5).mean().to_numpy(), equal_nan=True)
        np.testing.assert_allclose(g.volatility.to_numpy(dtype=float), s.rolling(5).std().to_numpy(),
                                   equal_nan=True, atol=1e-9)
        np.testing.assert_allclose(g.momentum.to_numpy(), np.cumsum(np.r_[0, np.diff(s.to_numpy())]))


def test_momentum_equivalence(spark):
    recs = [(1, w, (w * 7) % 11) for w in range(1, 31)] + [(2, 3, 5)]
    pts = spark.createDataFrame(recs, "player_id long, week int, points long")
    a = {(r.player_id, r.week): r.momentum for r in timeseries.rolling_form(pts).collect()}
    b = {(r.player_id, r.week): r.momentum for r in timeseries.momentum_by_differences(pts).collect()}
    assert a == b


def test_spine_reaches_the_last_week_of_the_data(spark):
    pts = spark.createDataFrame([(1, 1, 5), (1, 38, 9), (2, 35, 4), (3, 0, 7), (3, None, 1)], "player_id long, week int, points long")
    got = timeseries.rolling_form(pts)
    assert got.count() == 3 * 38
    seen = {(r.player_id, r.week): r.points for r in got.filter("points <> 0").collect()}
    assert seen == {(1, 1): 5, (1, 38): 9, (2, 35): 4}
    assert timeseries.rolling_form(pts, 45).count() == 3 * 45 and timeseries.rolling_form(pts, 10).count() == 3 * 38
    assert sorted((r.player_id, r.points) for r in timeseries.invalid_weeks(pts).collect()) == [(3, 1), (3, 7)]
    assert timeseries.rolling_form(pts.filter("week < 1")).count() == 0
    assert timeseries.rolling_form(pts.limit(0)).count() == 0


def test_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(4)
    recs = [(p, int(w), int(rng.integers(-5, 15))) for p in range(4) for w in rng.choice(np.arange(1, 70), 25, replace=False)]
    recs += [(7, None, 3), (8, 69, 2), (9, 1, 4), (9, 1, 6)]
    pts = spark.createDataFrame(recs, "player_id long, week int, points long")
    rows = lambda df: sorted(df.collect())
    want = rows(timeseries.rolling_form(pts))
    assert len(want) == 7 * 69
    for block in (1, 2, 3, 7, 23, 68, 69):
        assert rows(timeseries.rolling_form(pts, block=block)) == want
        by_sum = {(r.player_id, r.week): r.momentum for r in timeseries.momentum_by_differences(pts, block=block).collect()}
        assert by_sum == {(r.player_id, r.week): r.momentum for r in want}
        assert rows(timeseries.dense_weeks(pts, block=block)) == [(r.player_id, r.week, r.points) for r in want]


def test_a_player_with_a_million_weeks_is_spread(spark):
    n = 1_000_000
    pts = spark.range(1, n + 1).filter("id % 3 <> 0").selectExpr("1L AS player_id", "CAST(id AS INT) AS week", "id % 17 AS points")
    form = timeseries.rolling_form(pts, n_weeks=n, max_week=n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # else the few sparse rows are put into few tasks
    try:
        per_task = [r["count"] for r in form.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(per_task) == n and len(per_task) >= 4 and max(per_task) < n // 2
    i = np.arange(1, n + 1)
    x = pd.Series(np.where(i % 3, i % 17, 0).astype(float))
    got = form.agg(F.sum("ma_short"), F.sum("ma_long"), F.sum("volatility"), F.sum("momentum"), F.count("ma_long")).first()
    want = (x.rolling(3).mean().sum(), x.rolling(5).mean().sum(), x.rolling(5).std().sum(), (x - x[0]).sum(), n - 4)
    assert list(got) == pytest.approx(list(want), rel=1e-9)


def test_an_absurd_week_is_reported_and_costs_nothing(spark):
    pts = spark.createDataFrame([(1, 3, 5), (1, 2_000_000_000, 9), (2, 1, 4), (3, 10_001, 8)], "player_id long, week int, points long")
    assert sorted((r.player_id, r.week) for r in timeseries.invalid_weeks(pts).collect()) == [(1, 2_000_000_000), (3, 10_001)]
    got = timeseries.rolling_form(pts).collect()
    assert len(got) == 3 * 3 and sum(r.points for r in got) == 9
    assert timeseries.rolling_form(pts, max_week=10_001).filter("player_id = 3 AND points = 8").first().week == 10_001


def test_exact_quantiles_with_a_hot_value(spark):
    from pitchside.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "id": np.arange(n), "x": rng.normal(size=n)})
    pdf.loc[pdf.sample(frac=0.35, random_state=1).index, "x"] = 0.25   # a third of the rows share one value
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), "x", probs, ["g"]).collect()
    assert len(got) == 3 * len(probs)
    key = lambda r: (r.g, r.prob_idx, r.n, r["quantile"])
    for levels in (0, 1, 3):
        assert sorted(map(key, exact_quantiles(spark.createDataFrame(pdf), "x", probs, ["g"], 40, levels).collect())) == sorted(map(key, got))
    for row in got:
        want = np.percentile(pdf[pdf.g == row.g].x, probs[row.prob_idx] * 100)
        assert row["quantile"] == pytest.approx(want, abs=1e-12)
    whole = exact_quantiles(spark.createDataFrame(pdf), "x", probs).collect()
    assert [r["quantile"] for r in sorted(whole, key=lambda r: r.prob_idx)] == pytest.approx(list(np.percentile(pdf.x, [p * 100 for p in probs])), abs=1e-12)
    assert exact_quantiles(spark.createDataFrame(pdf).filter("x > 100"), "x", [0.5]).count() == 0


def test_exact_quantiles_beyond_the_sketch(spark):
    """More rows than the sketch holds exactly: the bracket is counted, and the answer is exact."""
    from pitchside.functions.quantiles import exact_quantiles
    rows = spark.range(600_000).select((F.pmod(F.xxhash64("id"), F.lit(10_000_019)) / 7.0).alias("x"))
    x = np.sort(rows.toPandas().x.to_numpy())
    got = {r.prob: r["quantile"] for r in exact_quantiles(rows, "x", [0.0, 0.25, 0.5, 0.999, 1.0]).collect()}
    assert got == pytest.approx({p: np.percentile(x, p * 100) for p in got}, abs=1e-9)


@pytest.mark.parametrize("levels", [1, 2])
def test_exact_quantiles_order_a_bounded_number_of_values(spark, levels, monkeypatch):
    """10^7 distinct values under a coarse sketch, a third of them crowded into one bin's width: few reach the last window."""
    from pitchside.functions import quantiles
    n, seen = 10_000_000, []
    mixed = F.pmod(F.col("id") * 7_654_321, F.lit(n))   # a permutation
    x = F.when(mixed < n // 3, mixed / 1e9).otherwise(mixed.cast("double") ** 1.5)
    rows = spark.range(n).select(x.alias("x"))
    kept = quantiles.last_candidates
    monkeypatch.setattr(quantiles, "last_candidates", lambda *a: seen.append(kept(*a)) or seen[-1])
    got = {r.prob: r["quantile"] for r in quantiles.exact_quantiles(rows, "x", [0.2, 0.33333, 0.5], accuracy=50, levels=levels).collect()}
    i = np.arange(n)
    want = np.sort(np.where(i < n // 3, i / 1e9, i.astype(float) ** 1.5))
    assert got == {p: pytest.approx(np.quantile(want, p), rel=1e-12) for p in got}
    largest = seen[0].groupBy("prob_idx", "_path", "_b").count().agg(F.max("count")).first()[0]
    assert largest < (400_000 if levels == 1 else 2_000)   # of 800,000 values in a bracket


def test_exact_quantiles_of_infinite_and_repeated_values(spark):
    from pitchside.functions.quantiles import exact_quantiles
    inf = float("inf")
    rows = [-inf] * 3 + [1.0] * 5 + [2.0, 1e308, -1e308] + [inf] * 4
    got = {r.prob: r["quantile"] for r in exact_quantiles(spark.createDataFrame([(v,) for v in rows], "x double"), "x", [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: -inf, 0.5: 1.0, 1.0: inf}
