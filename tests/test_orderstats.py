import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright import storage
from tabwright.operators.distribution import bin_means, box_outliers, box_statistics, histograms, scatter_density
from tabwright.operators.orderstats import quantiles
from tabwright.operators.profile import describe
from tabwright.operators.running import average_ranks, running_totals

RNG = np.random.default_rng(7)
N = 4000


@pytest.fixture(scope="module")
def frame():
    heavy = np.where(RNG.random(N) < 0.4, 5.0, RNG.normal(5, 2, N))
    return pd.DataFrame({
        "g": RNG.choice(["a", "b", "c"], N, p=[0.6, 0.3, 0.1]),
        "heavy": heavy,
        "tail": RNG.pareto(0.7, N),
        "few": RNG.integers(0, 7, N).astype(float),
        "constant": 3.0,
    })


@pytest.mark.parametrize("limit,levels,grid", [(1_000_000, 4, 4096), (40, 4, 64), (40, 4, 4096), (40, 1, 4)])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_match_numpy_whatever_the_limit(spark, frame, limit, levels, grid, by, monkeypatch):
    from tabwright.operators import orderstats
    monkeypatch.setattr(orderstats, "_LEVELS", levels)
    monkeypatch.setattr(orderstats, "_GRID", grid)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    columns = ["heavy", "tail", "few", "constant"]
    got = quantiles(spark.createDataFrame(frame), columns, probs, by, row_limit=limit).toPandas()
    groups = [((), frame)] if not by else [((k,), part) for k, part in frame.groupby("g")]
    assert len(got) == len(groups) * len(columns)
    for key, part in groups:
        for c in columns:
            row = got[got["feature"] == c]
            if key:
                row = row[row["g"] == key[0]]
            np.testing.assert_allclose(row[[f"q{i}" for i in range(len(probs))]].to_numpy()[0],
                                       part[c].quantile(list(probs)).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("by,here", [([], True), (["g"], True), (["g"], False)])
def test_marks_bracket_the_quantiles_of_many_values(spark, by, here, monkeypatch):
    """Two passes serve columns of different shapes at once, and nothing falls back on the search by levels."""
    from tabwright.operators import orderstats

    monkeypatch.setattr(orderstats, "order_statistics", None)
    if not here:  # as if the brackets were too many for the driver
        monkeypatch.setattr(orderstats, "side_table", lambda df, name: storage.side_table(df, name) if name == "sizes" else (storage.written(df, name), False))
    n = 150_000
    data = pd.DataFrame({"g": RNG.choice(["a", "b"], n, p=[0.7, 0.3]), "normal": RNG.normal(size=n), "tail": RNG.pareto(0.3, n),
                         "hot": np.where(RNG.random(n) < 0.6, 2.0, RNG.random(n) * 4), "few": RNG.integers(0, 3, n).astype(float)})
    data.loc[RNG.random(n) < 0.1, "normal"] = np.nan
    probs, columns = (0.0, 0.0004, 0.25, 0.5, 0.9, 1.0), ["normal", "tail", "hot", "few"]
    sc = spark.sparkContext
    rows = spark.createDataFrame(data).cache()
    rows.count()
    sc.setJobGroup("marks", "")
    got = quantiles(rows, columns, probs, by, row_limit=100_000)
    assert not here or len(sc.statusTracker().getJobIdsForGroup("marks")) <= (11 if by else 8)
    sc.setJobGroup("tests", "")
    got = got.toPandas()
    for key, part in [((), data)] if not by else [((k,), p) for k, p in data.groupby("g")]:
        for c in columns:
            row = got[(got["feature"] == c) & ((got["g"] == key[0]) if key else True)]
            np.testing.assert_allclose(row[[f"q{i}" for i in range(len(probs))]].to_numpy()[0], part[c].quantile(list(probs)).to_numpy(), rtol=1e-12)


def test_more_groups_than_a_side_table_holds(spark, frame, monkeypatch):
    from tabwright.operators import orderstats

    monkeypatch.setattr(orderstats, "side_table", lambda df, name, limit=2: storage.side_table(df, name, 2))
    got = quantiles(spark.createDataFrame(frame), ["heavy", "few"], (0.25, 0.5), ["g"]).toPandas().set_index(["g", "feature"])
    for g, part in frame.groupby("g"):
        for c in ("heavy", "few"):
            np.testing.assert_allclose(got.loc[(g, c), ["q0", "q1"]].astype(float), part[c].quantile([0.25, 0.5]))


def test_infinite_values_take_the_sketch_route(spark):
    data = pd.DataFrame({"x": np.concatenate([RNG.normal(size=500), [np.inf, -np.inf, np.inf]])})
    got = quantiles(spark.createDataFrame(data), ["x"], (0.0, 0.5, 1.0), row_limit=20).first()
    ordered = np.sort(data["x"])
    assert (got["q0"] == -np.inf or np.isnan(got["q0"])) and got["q1"] == ordered[251]


def test_one_value_holding_nearly_all_rows_does_not_stall_the_search(spark):
    rare = RNG.normal(0, 1, 300)
    data = pd.DataFrame({"x": np.concatenate([np.full(200_000, 9.0), rare])})
    got = quantiles(spark.createDataFrame(data), ["x"], (0.0005, 0.001, 0.5), row_limit=5).first()
    np.testing.assert_allclose([got["q0"], got["q1"], got["q2"]],
                               data["x"].quantile([0.0005, 0.001, 0.5]))


def test_describe_with_nulls_nan_and_empty_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("a", float("nan"), None), ("a", 4.0, None), ("b", None, None), (None, 7.0, None)],
        "g string, x double, y double")
    whole = {r["feature"]: r for r in describe(df).collect()}
    assert whole["x"]["count"] == 3 and whole["x"]["p50"] == 4.0
    assert whole["y"]["count"] == 0 and whole["y"]["p50"] is None and whole["y"]["mean"] is None
    grouped = {(r["g"], r["feature"]): r for r in describe(df, by=["g"]).collect()}
    assert grouped["a", "x"]["p25"] == 1.75 and grouped["b", "x"]["count"] == 0
    assert (None, "x") not in grouped


@pytest.mark.parametrize("window_rows", [1_000_000, 200])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_cumsum(spark, frame, window_rows, descending):
    df = spark.createDataFrame(frame)
    got = running_totals(df, "heavy", {"n": F.count(F.lit(1)), "s": F.sum("few")}, ["g"], descending,
                         window_rows).toPandas()
    for g, part in frame.groupby("g"):
        want = part.groupby("heavy")["few"].agg(["size", "sum"]).sort_index(ascending=not descending)
        mine = got[got["g"] == g].set_index("heavy").sort_index(ascending=not descending)
        assert list(mine["n"]) == list(want["size"])
        assert list(mine["n_before"]) == list(want["size"].cumsum() - want["size"])
        assert list(mine["s_before"]) == list(want["sum"].cumsum() - want["sum"])
        assert list(mine["n_next"].iloc[:-1]) == list(want["size"].iloc[1:])
        assert pd.isna(mine["n_next"].iloc[-1])


def test_average_ranks_match_pandas_on_both_routes(spark, frame, monkeypatch):
    data = frame.assign(id=range(N))
    data.loc[::17, "heavy"] = None
    want = data.set_index("id")["heavy"].rank()
    df = spark.createDataFrame(data)
    from tabwright.operators import running
    for side_rows in (10_000, 10):
        monkeypatch.setattr(running, "SIDE_TABLE_ROWS", side_rows)
        got = average_ranks(df, "heavy", hot_values=20).toPandas().set_index("id")["rank"].sort_index()
        pd.testing.assert_series_equal(got, want, check_names=False)


def test_histograms_leave_missing_values_out(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None), (float("nan"), None)], "x double, y double")
    got = histograms(df, {"x": 2, "y": 3}).orderBy("bin").collect()
    assert [(r["feature"], r["n"]) for r in got] == [("x", 1), ("x", 1)]


def test_histograms_match_numpy(spark, frame):
    got = histograms(spark.createDataFrame(frame), {"heavy": 40, "few": 6, "constant": 5}).toPandas()
    for c, bins in (("heavy", 40), ("few", 6), ("constant", 5)):
        counts, edges = np.histogram(frame[c], bins)
        mine = got[got["feature"] == c].sort_values("bin")
        assert list(mine["n"]) == list(counts)
        np.testing.assert_allclose(mine["lo"], edges[:-1])
        np.testing.assert_allclose(mine["hi"], edges[1:])


def test_bin_means_match_cut(spark, frame):
    data = pd.DataFrame({"x": [0, 1, 2, 3, 4, 10, 10], "y": [1.0, 2, 3, 4, 5, 6, 8]})
    for d, x, y in ((data, "x", "y"), (frame, "heavy", "few"), (frame, "constant", "few")):
        bins = pd.cut(d[x], bins=5)
        want = d.groupby(bins, observed=False)[y].mean()
        got = bin_means(spark.createDataFrame(d), x, y).orderBy("bin").toPandas()
        np.testing.assert_allclose(got["mean"].astype(float), want.to_numpy())
        exact = pd.cut(d[x], bins=5, retbins=True)[1]
        np.testing.assert_allclose(got["lo"], exact[:-1])
        np.testing.assert_allclose(got["hi"], exact[1:])


def test_box_statistics(spark, frame):
    df = spark.createDataFrame(frame)
    got = box_statistics(df, "tail", "g", row_limit=50).toPandas().set_index("g")
    outliers = box_outliers(df, "tail", "g").toPandas()
    for g, part in frame.groupby("g"):
        q1, q2, q3 = part["tail"].quantile([0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = part["tail"][(part["tail"] >= lo) & (part["tail"] <= hi)]
        assert got.loc[g, "whisker_hi"] == inside.max() and got.loc[g, "whisker_lo"] == inside.min()
        np.testing.assert_allclose(got.loc[g, "median"], q2)
        assert got.loc[g, "outliers"] == len(part) - len(inside) == (outliers["g"] == g).sum()


def test_scatter_density_keeps_every_point(spark, frame):
    got = scatter_density(spark.createDataFrame(frame), "heavy", "few", 10).toPandas()
    counts, _, _ = np.histogram2d(frame["heavy"], frame["few"], 10)
    assert got["n"].sum() == N
    for r in got.itertuples():
        assert counts[r.x_bin, r.y_bin] == r.n
