"""Limits and switches that must not change a result."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabwright import storage
from tabwright.operators import distribution, evaluate, orderstats, profile, running, sampling
from tabwright.plans import jobs


def numbers(spark, n=900, keys=None):
    return spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 501).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("g"),
                                 (F.col("id") % (keys or n)).alias("key"))


@pytest.mark.parametrize("window_rows", [1_000_000, 40])
def test_ranks_and_areas_do_not_depend_on_the_window(spark, window_rows):
    df = numbers(spark).withColumn("x", F.when(F.col("id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("x")))
    got = running.average_ranks(df, "x", window_rows=window_rows).select("id", "rank").collect()
    values = {r["id"]: r["x"] for r in df.collect()}
    known = sorted(v for v in values.values() if not math.isnan(v))
    place = {v: (known.index(v) + 1 + known.index(v) + known.count(v)) / 2 for v in set(known)}
    assert {r["id"]: r["rank"] for r in got} == {i: place.get(v) for i, v in values.items()}
    clean = df.where(~F.isnan("x"))
    area = evaluate.auc(clean, "x", F.col("g") == "1", window_rows=window_rows).first()[0]
    positive = [v for i, v in values.items() if i % 3 == 1 and not math.isnan(v)]
    negative = [v for i, v in values.items() if i % 3 != 1 and not math.isnan(v)]
    want = sum((p > n) + (p == n) / 2 for p in positive for n in negative) / len(positive) / len(negative)
    assert area == pytest.approx(want)
    with pytest.raises(Exception, match="NaN score"):
        evaluate.auc(df, "x", F.col("g") == "1", window_rows=window_rows).collect()


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_by_key_in_partitions(spark, descending):
    df = numbers(spark)
    measures = {"n": F.count(F.lit(1))}
    whole, cut = (sorted(map(tuple, running.running_totals(df, "x", measures, ["g"], descending, w).select("g", "x", "n", "n_before", "n_next").collect()), key=repr)
                  for w in (10**6, 30))
    assert whole == cut


def test_infinite_values_are_refused_by_bins(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("inf"), 2.0)], "x double, y double")
    for bins in (lambda: distribution.histograms(df, {"x": 4}), lambda: distribution.bin_means(df, "x", "y"), lambda: distribution.scatter_density(df, "x", "y")):
        with pytest.raises(ValueError, match="infinite"):
            bins()
    assert orderstats.quantile_values(spark.createDataFrame([(1.0,), (4.0,), (float("inf"),)], "x double"), ["x"], [0.5]) == {"x": [4.0]}


def test_subsample_is_exact_with_repeated_keys(spark):
    df = numbers(spark, 1000, keys=10)
    for stratum in (None, "g"):
        got = sampling.subsample(df, F.col("key"), 250, stratum=stratum).collect()
        assert len(got) == 250 and len({r["id"] for r in got}) == 250
        again = sampling.subsample(df.repartition(7), F.col("key"), 250, stratum=stratum).collect()
        assert {r["id"] for r in got} == {r["id"] for r in again}


def test_missing_keys_are_keys(spark):
    df = numbers(spark, 1000).withColumn("key", F.when(F.col("id") >= 500, F.col("id")))
    parts = Counter(r["part"] for r in sampling.exact_split(df, F.col("key")).collect())
    assert sum(parts.values()) == 1000
    apart = sampling.exact_split(df, F.coalesce(F.col("key"), -F.col("id") - 1))
    assert Counter(r["part"] for r in apart.collect()) == {"test": 200, "val": 200, "train": 600}


def test_many_strata_join_their_cuts(spark, monkeypatch):
    df = spark.range(6000).select("id", (F.col("id") % 1500).cast("string").alias("s"))
    joined = [sampling.exact_split(df, F.col("id"), stratum="s"), sampling.folds(df, F.col("id"), stratum="s"), sampling.subsample(df, F.col("id"), 1700, stratum="s")]
    joined = [sorted(map(tuple, x.collect())) for x in joined]
    monkeypatch.setattr(sampling, "LITERAL_STRATA", 10_000)
    literal = [sampling.exact_split(df, F.col("id"), stratum="s"), sampling.folds(df, F.col("id"), stratum="s"), sampling.subsample(df, F.col("id"), 1700, stratum="s")]
    assert joined == [sorted(map(tuple, x.collect())) for x in literal]
    assert Counter(r[2] for r in joined[0])["test"] == 1200 and len(joined[2]) == 1700


def test_curves_bound_the_fit_rows_only(spark):
    df = numbers(spark, 600).withColumn("h", F.col("id"))
    folded = sampling.folds(df, F.col("h"), 3, None)
    assert {s["size"] for s in sampling.nested_prefixes(folded, F.col("h"), [0.5, 1.0], None, most=100)} == {50, 100}


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, None), (1.0, "a")], "`b.c` double, `t=1.5` string")
    assert profile.duplicate_rows(df).first()[0] == 1
    assert {r["feature"]: r["missing"] for r in profile.missing_counts(df).collect()} == {"b.c": 1, "t=1.5": 1}
    assert profile.describe(df, ["b.c"]).first()["p50"] == 1.0


def test_duplicates_by_digest(spark, monkeypatch):
    """Digests that collide, many repeated ones and odd types change nothing."""
    rows = [(k % 400, None if k % 7 == 0 else float(k % 50), "x" * (k % 3), [k % 2, None], {"a": k % 2}) for k in range(3000)] + [(1, -0.0, None, None, None), (1, 0.0, None, None, None),
            (None, 1.0, None, None, None), (1, None, None, None, None), (1, float("nan"), "", [], {}), (1, float("nan"), "", [], {})]
    df = spark.createDataFrame(rows, "a int, `row` double, high string, xs array<int>, m map<string,int>").repartition(5)
    want = len(rows) - df.groupBy(*df.columns).count().count()
    assert want >= 2
    collide = lambda df: (F.lit(1).cast("long"), F.pmod(F.xxhash64("a"), F.lit(2)))
    for digest in (profile.row_digest, collide):
        assert profile.duplicate_rows(df, digest).first()[0] == want
    monkeypatch.setattr(profile, "side_table", lambda df, name: storage.side_table(df, name, 3))
    for buckets in (1, 64, 1 << 20):
        monkeypatch.setattr(profile, "DIGEST_BUCKETS", buckets)
        assert profile.duplicate_rows(df).first()[0] == want
    assert profile.duplicate_rows(df.limit(0)).first()[0] == 0 == profile.duplicate_rows(df.drop("m").dropDuplicates()).first()[0]


def test_rows_without_a_copy_are_not_shuffled(spark):
    df = spark.range(50_000).select("id", F.lpad(F.col("id").cast("string"), 400, "x").alias("wide"))
    text = profile.duplicate_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in text and "SortMergeJoin" not in text  # no digest repeats: the semi join leaves nothing to shuffle


def test_crosstab_in_long_form(spark):
    df = numbers(spark, 90)
    wide = profile.crosstab(df, "g", "key").collect()
    long = {(r["row"], str(r["value"])): r["share"] for r in profile.crosstab_long(df, "g", "key").collect()}
    assert long == {(r["g"], c): r[c] for r in wide for c in r.asDict() if c != "g" and r[c]}
    with pytest.raises(ValueError, match="crosstab_long"):
        profile.crosstab(df, "g", "key", most_values=20)


def test_profile_reads_the_table_equally_often_for_many_columns(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("y"), *[(F.col("id") * (7 + i) % 97).cast("double").alias(f"x{i}") for i in range(8)],
                                  *[(F.col("id") % (3 + i)).cast("string").alias(f"t{i}") for i in range(8)])
    jobs_of = {}
    for n in (2, 8):
        spark.sparkContext.setJobGroup(f"profile-{n}", "count jobs")
        for part in jobs.profile_by_label(df, "y", [f"x{i}" for i in range(n)], [f"t{i}" for i in range(n)]).values():
            part.collect()
        jobs_of[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"profile-{n}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs_of[8] <= jobs_of[2] + 2


def test_running_totals_evaluate_their_source_once(spark):
    """Whether the distinct values fit one window or are cut into ranges."""
    for window_rows in (1_000, 50):
        seen = spark.sparkContext.accumulator(0)

        def meet(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = spark.range(500).selectExpr("id % 200 AS v").mapInArrow(meet, "v long")
        found = running.running_totals(rows, "v", {"n": F.count(F.lit(1))}, window_rows=window_rows).orderBy("v").collect()
        before = 0
        for i, r in enumerate(found):
            n = 3 if i < 100 else 2
            assert (r["v"], r["n"], r["n_before"], r["n_next"]) == (i, n, before, None if i == 199 else 3 if i < 99 else 2)
            before += n
        assert len(found) == 200 and seen.value == 500
