import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.functions.cleaning import mapped_score
from tabwright.operators import sampling
from tabwright.operators.labels import fit_rank_bins, grade, insurance_quality, median_bin, risk_label

RNG = np.random.default_rng(11)


def qcut_bins(values, q=3):
    ranks = pd.Series(values).rank()
    codes = pd.qcut(ranks, q, labels=False, duplicates="drop")
    return codes.astype(float) + 1


@pytest.mark.parametrize("values", [
    list(range(1, 20)),
    list(RNG.integers(0, 4, 101)),
    list(RNG.integers(0, 9, 100)) + [3] * 50,
    list(RNG.normal(size=61)) + [None, float("nan")],
    [1.0, 1.0, 1.0, 1.0, 2.0],
])
@pytest.mark.parametrize("limit", [1_000_000, 4])
def test_rank_bins_match_qcut(spark, values, limit):
    data = pd.DataFrame({"id": range(len(values)), "x": [None if v is None else float(v) for v in values]})
    df = spark.createDataFrame(data)
    bins = fit_rank_bins(df, ["x"], row_limit=limit)["x"]
    got = df.select("id", bins.bin().alias("b")).toPandas().sort_values("id")["b"].astype(float)
    np.testing.assert_array_equal(got.to_numpy(), qcut_bins(data["x"]).to_numpy())


def test_degenerate_columns_have_no_bins(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "x double, y double")
    fitted = fit_rank_bins(df, ["x", "y"])
    assert fitted["x"].bins == 0 and fitted["y"].bins == 0
    assert {r["g"] for r in grade(df, "x", "g").collect()} == {"medium"}
    assert {r["g"] for r in grade(df, "y", "g").collect()} == {None}
    assert median_bin(df, fitted["x"]) is None


def pandas_quality(d, plan_scores, network_scores):
    def tercile(s):
        r = s.rank()
        k = pd.qcut(r, 3, duplicates="drop").cat.categories.size
        return (k + 1) - qcut_bins(s)
    plan = d["plan_type"].str.strip().str.lower().map(plan_scores).fillna(2.0)
    net = d["network_tier"].str.strip().str.lower().map(network_scores).fillna(2.0)
    ded, prem = (tercile(pd.to_numeric(d[c], errors="coerce")) for c in ("deductible", "monthly_premium"))
    score = 0.35 * plan + 0.30 * net + 0.20 * ded.fillna(ded.median()) + 0.15 * prem.fillna(prem.median())
    return qcut_bins(score).map({1.0: "low", 2.0: "medium", 3.0: "high"})


def test_quality_matches_pandas(spark):
    n = 1000
    d = pd.DataFrame({
        "id": range(n),
        "plan_type": RNG.choice(["PPO", " hmo ", "EPO", "POS"], n),
        "network_tier": RNG.choice(["Gold", "Silver", "Bronze", "Platinum"], n),
        "deductible": RNG.choice(["500", "1000", "2500", "5000", "n/a"], n),
        "monthly_premium": RNG.gamma(2, 50, n).round(2),
    })
    from tabwright import presets
    got = insurance_quality(spark.createDataFrame(d)).select("id", "insurance_quality").toPandas()
    want = pandas_quality(d, presets.PLAN_SCORES, presets.NETWORK_SCORES)
    assert list(got.sort_values("id")["insurance_quality"]) == list(want)
    with pytest.raises(ValueError, match="network_tier"):
        insurance_quality(spark.createDataFrame(d.drop(columns="network_tier")))


def test_risk_label_sources(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0), (4, None)], "id int, charges double")
    assert [r["risk_label"] for r in risk_label(df).orderBy("id").collect()] == [0, 0, 1, 0]
    assert [r["risk_label"] for r in risk_label(df.withColumn("is_high_risk", F.lit(1))).collect()] == [1] * 4
    with pytest.raises(ValueError):
        risk_label(df.select("id"))


def test_mapped_score_defaults(spark):
    df = spark.createDataFrame([("A ",), ("b",), ("z",), (None,)], "x string")
    got = [r[0] for r in df.select(mapped_score(F.col("x"), {"a": 3, "b": 1})).collect()]
    assert got == [3.0, 1.0, 2.0, 2.0]


@pytest.fixture(scope="module")
def people(spark):
    n = 3001
    return spark.createDataFrame(pd.DataFrame({
        "id": range(n), "y": RNG.choice(["low", "mid", "high"], n, p=[0.7, 0.2, 0.1])}))


def parts(df, column):
    return df.select("id", column).toPandas().set_index("id")[column].sort_index()


@pytest.mark.parametrize("assign,column", [
    (lambda d: sampling.random_split(d, F.col("id")), "part"),
    (lambda d: sampling.exact_split(d, F.col("id"), stratum="y"), "part"),
    (lambda d: sampling.folds(d, F.col("id"), stratum="y"), "fold"),
])
def test_assignment_ignores_partitioning(people, assign, column):
    first = parts(assign(people), column)
    pd.testing.assert_series_equal(first, parts(assign(people.orderBy(F.rand(3)).repartition(17)), column))


@pytest.mark.parametrize("limit", [1_000_000, 100])
def test_exact_split_sizes(people, limit):
    got = sampling.exact_split(people, F.col("id"), stratum="y", row_limit=limit).toPandas()
    assert got["part"].value_counts().to_dict() == {"test": 601, "val": 600, "train": 1800}
    for _, part in got.groupby("y"):
        assert abs((part["part"] == "test").sum() - 0.2 * len(part)) <= 1
    plain = sampling.exact_split(people, F.col("id")).groupBy("part").count().toPandas()
    assert plain.set_index("part")["count"].to_dict() == {"test": 601, "val": 600, "train": 1800}


def test_subsample_is_exact(people):
    got = sampling.subsample(people, F.col("id"), 500, stratum="y").toPandas()
    assert len(got) == 500
    whole = people.toPandas()["y"].value_counts(normalize=True)
    for y, share in got["y"].value_counts(normalize=True).items():
        assert abs(share - whole[y]) < 0.01
    assert sampling.subsample(people, F.col("id"), 9999).count() == 3001


def test_folds_are_balanced(people):
    got = sampling.folds(people, F.col("id"), 3, stratum="y").toPandas()
    sizes = got["fold"].value_counts()
    assert sizes.max() - sizes.min() <= 1
    for _, part in got.groupby("y"):
        counts = part["fold"].value_counts()
        assert counts.max() - counts.min() <= 1
    plain = sampling.folds(people, F.col("id"), 4).groupBy("fold").count().orderBy("fold").toPandas()
    assert list(plain["count"]) == [751, 750, 750, 750]


def test_nested_prefixes(people):
    folded = sampling.folds(people, F.col("id"), 3)
    steps = sampling.nested_prefixes(folded, F.col("id"), [0.1, 0.5, 1.0])
    h = sampling.key_hash(F.col("id"), 42)
    for s in steps:
        assert folded.where((F.col("fold") != s["fold"]) & (h < s["cut"])).count() == s["size"]
    assert sorted({s["size"] for s in steps}) == [200, 1000, 2000]


def test_random_row_comes_from_the_table(people):
    first = sampling.random_row(people, F.col("id"), 1).collect()
    assert len(first) == 1 and first == sampling.random_row(people.repartition(5), F.col("id"), 1).collect()


def many_strata(spark, n=3000):
    """Strata of 1 to 20 rows, ties of sizes among them, and one that holds a third of all rows."""
    rng = np.random.default_rng(4)
    names = [f"s{k}" for k in rng.integers(0, 300, n)]
    return spark.createDataFrame([(k, "hot" if k % 3 == 0 else names[k], float(k)) for k in range(n)], "id long, stratum string, x double").repartition(4).cache()


def test_a_table_of_strata_gives_the_splits_of_a_few(spark, monkeypatch):
    df, key = many_strata(spark), F.col("id")

    def all_parts():
        split = sampling.exact_split(df, key, 7, 0.2, 0.25, "stratum")
        folded = sampling.folds(df, key, 4, 7, "stratum")
        taken = sampling.subsample(df.withColumn("id", F.col("id") % 500), key, 700, 7, "stratum")
        return ({r["id"]: r["part"] for r in split.collect()}, {r["id"]: r["fold"] for r in folded.collect()}, sorted(r["x"] for r in taken.collect()))

    few = all_parts()
    monkeypatch.setattr(sampling, "LITERAL_STRATA", 10)
    many = all_parts()
    assert few[1] == many[1] and len(few[2]) == len(many[2]) == 700
    for a, b in zip(few[:1], many[:1]):
        assert {p: list(a.values()).count(p) for p in ("train", "val", "test")} == {p: list(b.values()).count(p) for p in ("train", "val", "test")}
        # Remainders that are equal may differ by rounding on the driver; strata are named alike where they do not.
        assert sum(a[k] != b[k] for k in a) <= 0.02 * len(a)


def test_a_missing_stratum_is_refused_in_a_table(spark, monkeypatch):
    monkeypatch.setattr(sampling, "LITERAL_STRATA", 10)
    df = many_strata(spark, 300).withColumn("stratum", F.when(F.col("id") != 5, F.col("stratum")))
    with pytest.raises(ValueError, match="missing"):
        sampling.folds(df, F.col("id"), 3, 42, "stratum")


def test_apportioned_is_exact(spark):
    sizes = spark.createDataFrame([(f"k{k:03d}", 1 + k % 7) for k in range(200)], "stratum string, n long")
    total = 333
    got = {r["stratum"]: r["given"] for r in sampling._apportioned(sizes, "n", total, "given").collect()}
    rows = {r["stratum"]: r["n"] for r in sizes.collect()}
    n = sum(rows.values())
    order = sorted(rows, key=lambda k: (-(total * rows[k] % n), k))
    floors = {k: total * v // n for k, v in rows.items()}
    extra = set(order[:total - sum(floors.values())])
    assert got == {k: floors[k] + (k in extra) for k in rows} and sum(got.values()) == total
