"""Grid search, the model loop, learning curves and ablations."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright import presets
from tabwright.functions.hashing import key_hash
from tabwright.operators import sampling
from tabwright.operators.evaluate import auc, auc_ovr_macro, class_metrics, confusion, regression_metrics
from tabwright.operators.features import preparation_stages
from tabwright.operators.models import CLASSIFIERS, REGRESSORS, build_classifier, build_regressor, weighs
from tabwright.operators.moments import LINEAR, fold_moments
from tabwright.operators.roles import Roles, infer_roles, without
from tabwright.operators.scoring import class_scores
from tabwright.storage import use_checkpoints, written


#: Most classes a classifier is trained on, unless asked otherwise.
MAX_CLASSES = 1_000
#: Most rows of one partition that learners pass over.
TASK_ROWS = 1_000_000
#: Mean of a numeric target over rows with the same inputs.
MEAN = "mean_"


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of a parameter grid, in the order of sorted names."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]


def spread(df: DataFrame, most: int = TASK_ROWS) -> DataFrame:
    """``df`` as it is, or dealt out anew if a partition has more than ``most`` rows."""
    sizes = df.groupBy(F.spark_partition_id().alias("part_")).count().agg(F.max("count"), F.sum("count")).first()
    return df if (sizes[0] or 0) <= most else df.repartition(sizes[1] // most + 1)


@dataclass
class Search:
    params: dict
    scores: list[dict]
    model: PipelineModel


@dataclass
class Trainer:
    """One supervised task: how to prepare features, build a learner and score predictions."""

    roles: Roles
    target: str
    classes: list[str] | None = None
    seed: int = 42
    parallelism: int = 2
    max_bins: int = 32

    @property
    def classifies(self) -> bool:
        return self.classes is not None

    def labelled(self, df: DataFrame) -> DataFrame:
        if not self.classifies:
            return df.withColumn("label", F.col(self.target).cast("double"))
        codes = F.create_map(*[F.lit(x) for i, c in enumerate(self.classes) for x in (c, float(i))])
        return df.withColumn("label", codes[F.col(self.target).cast("string")])

    def build(self, name: str, params: Mapping):
        if self.classifies:
            return build_classifier(name, params, len(self.classes), self.seed, max_bins=self.max_bins)
        return build_regressor(name, params, self.seed, max_bins=self.max_bins)

    def prepare(self, train: DataFrame) -> PipelineModel:
        return Pipeline(stages=preparation_stages(self.roles)).fit(train)

    def prepared_rows(self, prepared: PipelineModel, df: DataFrame) -> DataFrame:
        """Feature vectors and labels, kept for the passes of the fits that share them."""
        needed = df.select(*dict.fromkeys([*self.roles.columns, self.target]))
        return prepared.transform(self.labelled(spread(needed))).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)

    def weighted_rows(self, prepared: PipelineModel, df: DataFrame) -> DataFrame:
        """Feature vectors, labels and ``weight``, one row for all that have the same inputs and class.

        For numbers, one for all with the same inputs, whose label is their mean: squared errors around it are the same for every model.
        """
        keys = list(dict.fromkeys(self.roles.columns))
        weight, target = F.count(F.lit(1)).cast("double").alias("weight"), F.col(self.target)
        if self.classifies:
            groups = df.groupBy(*dict.fromkeys([*keys, self.target])).agg(weight)
        else:
            groups = df.groupBy(*keys, target.isNull().alias("missing_")).agg(weight, F.avg(target.cast("double")).alias(MEAN))
        groups = spread(written(groups, "training-groups"))
        labelled = self.labelled(groups) if self.classifies else groups.withColumn("label", F.col(MEAN))
        return prepared.transform(labelled).select("features", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)

    def fitting_rows(self, prepared: PipelineModel, df: DataFrame, jobs: Sequence[tuple[str, Mapping]]) -> dict[bool, DataFrame]:
        """Rows to fit on, by whether a learner takes weighted ones."""
        return {w: (self.weighted_rows if w else self.prepared_rows)(prepared, df) for w in sorted({weighs(*job) for job in jobs})}

    def fit_on(self, rows: Mapping[bool, DataFrame], name: str, params: Mapping):
        weighted, learner = weighs(name, params), self.build(name, params)
        if weighted:
            learner.set(learner.getParam("weightCol"), "weight")
        return learner.fit(rows[weighted])

    def fit_all(self, params: Mapping[str, Mapping], train: DataFrame) -> dict[str, PipelineModel]:
        """Fit several models on one preparation of the training rows."""
        prepared = self.prepare(train)
        rows = self.fitting_rows(prepared, train, list(params.items()))
        try:
            with ThreadPoolExecutor(self.parallelism) as pool:
                learners = list(pool.map(lambda n: self.fit_on(rows, n, params[n]), params))
        finally:
            for part in rows.values():
                part.unpersist()
        return {n: PipelineModel([*prepared.stages, learner]) for n, learner in zip(params, learners)}

    def fit(self, name: str, params: Mapping, train: DataFrame) -> PipelineModel:
        return self.fit_all({name: params}, train)[name]

    def accuracy(self, scored: DataFrame) -> float:
        return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]

    def score(self, scored: DataFrame) -> float:
        """Larger is better: macro F1 for classes, negative root mean squared error for numbers."""
        if self.classifies:
            return class_metrics(confusion(scored, "label", "prediction")).first()["f1_macro"]
        return -regression_metrics(scored, "label", "prediction").first()["rmse"]

    def search(self, grids: Mapping[str, Mapping[str, Sequence]], train: DataFrame, fold: str, k: int) -> dict[str, Search]:
        """Best grid point of each model by its mean score over the folds, refitted on all of ``train``.

        Linear learners are scored from the moments of the folds, where these can serve (see ``moments``); for the others,
        preparation is fitted once per fold, on the training rows of that fold only, and shared by
        all models and grid points. The first of equally good points wins.
        """
        points = {name: grid_points(grid) for name, grid in grids.items()}
        tried = [(name, p) for name, ps in points.items() if len(ps) > 1 for p in ps]
        linear = [job for job in tried if not self.classifies and job[0] in LINEAR]
        solved = fold_moments(train, self.roles, self.target, fold, k) if linear else None
        if solved:
            tried = [job for job in tried if job not in linear]
        by_point: list[list[float]] = [[] for _ in tried]
        for f in range(k if tried else 0):
            fit_rows, held_rows = train.where(F.col(fold) != f), train.where(F.col(fold) == f)
            prepared = self.prepare(fit_rows)
            fit_on, held = self.fitting_rows(prepared, fit_rows, tried), self.prepared_rows(prepared, held_rows)

            def one(job: tuple[str, dict]) -> float:
                return self.score(self.fit_on(fit_on, *job).transform(held))

            try:
                with ThreadPoolExecutor(self.parallelism) as pool:
                    for scores, value in zip(by_point, pool.map(one, tried)):
                        scores.append(value)
            finally:
                for part in (*fit_on.values(), held):
                    part.unpersist()
        found: dict[str, list[dict]] = {name: [] for name in grids}
        if solved:
            tried, by_point = linear + tried, solved.scores(linear) + by_point
        for (name, p), scores in zip(tried, by_point):
            found[name].append({"params": p, "fold_scores": scores, "mean_score": sum(scores) / k})
        best = {name: max(found[name], key=lambda s: s["mean_score"])["params"] if found[name] else points[name][0]
                for name in grids}
        fitted = self.fit_all(best, train)
        return {name: Search(best[name], found[name], fitted[name]) for name in grids}


def classes_of(df: DataFrame, target: str, most: int = MAX_CLASSES) -> list[str]:
    """Ascending classes of a target, as text; a target with more than ``most`` values is refused."""
    known = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("c")).distinct()
    rows = known.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{target!r} has more than {most} values, too many for classes")
    return sorted(r["c"] for r in rows)


@dataclass
class Run:
    """Result of a model loop. ``metrics`` has one row per model, the best first."""

    best: str
    best_score: float
    model: PipelineModel
    metrics: DataFrame
    confusions: DataFrame | None
    searches: dict[str, Search] = field(default_factory=dict)
    roles: Roles | None = None
    inputs: T.StructType | None = None
    classes: list[str] | None = None


def _check(models: Sequence[str], known: Sequence[str]) -> None:
    for m in models:
        if m not in known:
            raise ValueError(f"unknown model {m!r}, choose from {sorted(known)}")


def _metrics_frame(like: DataFrame, rows: list[dict], order: str, ascending: bool) -> DataFrame:
    table = like.sparkSession.createDataFrame(pa.Table.from_pylist(rows))
    return table.orderBy(F.col(order).asc() if ascending else F.col(order).desc(), "model")


def _tuned(models: Sequence[str], grids: Mapping[str, Mapping]) -> bool:
    return any(len(grid_points(grids.get(m, {}))) > 1 for m in models)


def _partitioned(df: DataFrame, key: Column, features: Sequence[str], target: str, stratum: str | None, k: int,
                 seed: int, test: float, val: float, tuned: bool) -> tuple[DataFrame, DataFrame]:
    """The needed columns with part and fold, written once since each fit reads them many times."""
    place = F.col("_place")
    table = written(df.select(*features, target, key_hash(key, seed).alias("_place")), "training")
    parts = sampling.exact_split(table, place, None, test, val, stratum, "_part")
    train = parts.where(F.col("_part") == "train")
    if tuned:
        train = sampling.folds(train, place, k, None, stratum, "_fold")
        # Every fit of every fold reads these rows several times, so they are cut into folds once.
        train = written(train, "folds")
    return parts, train


def train_classifiers(
    df: DataFrame, target: str, key: Column, models: Sequence[str] = ("logreg_l2", "logreg_l1"),
    drop: Sequence[str] = (), grids: Mapping[str, Mapping] | None = None, folds: int = 3, seed: int = 42,
    test: float = 0.2, val: float = 0.2, select_by: str = "test_mcc", parallelism: int = 2, roles: Roles | None = None,
    most_classes: int = MAX_CLASSES,
) -> Run:
    """Split, tune, fit and compare classifiers on one target.

    The target and every column of ``drop`` stay out of the features. The best model has the
    highest ``select_by``; choosing on a ``val_`` figure keeps the test part untouched.
    """
    _check(models, CLASSIFIERS)
    use_checkpoints(df.sparkSession)
    grids = grids or presets.CLASSIFIER_GRIDS
    classes = classes_of(df, target, most_classes)
    roles = roles or infer_roles(without(df, [target, *drop]))
    known = df.where(F.col(target).isNotNull())
    parts, train = _partitioned(known, key, roles.columns, target, target, folds, seed, test, val, _tuned(models, grids))
    trainer = Trainer(roles, target, classes, seed, parallelism)
    searches = trainer.search({m: grids.get(m, {}) for m in models}, train, "_fold", folds)
    rows, confusions = [], None
    for name, found in searches.items():
        scored = class_scores(found.model.transform(trainer.labelled(parts.where(F.col("_part") != "train"))), classes)
        scored = scored.select("_part", F.col(target).cast("string").alias("actual"),
                               "predicted", "scores").persist(StorageLevel.MEMORY_AND_DISK)
        counts = confusion(scored, "actual", "predicted", ["_part"]).withColumnRenamed("_part", "split")
        row = {"model": name}
        for r in class_metrics(counts, ["split"]).collect():
            row |= {f"{r['split']}_{m}": r[m] for m in ("accuracy", "f1_macro", "mcc")}
        tested = scored.where(F.col("_part") == "test")
        if len(classes) == 2:
            row["test_roc_auc"] = auc(tested.withColumn("s", F.col("scores")[1]), "s",
                                      F.col("actual") == classes[1]).first()[0]
        else:
            row["test_roc_auc_ovr_macro"] = auc_ovr_macro(tested, "actual", "scores", classes).first()[0]
        row["best_params"] = json.dumps(found.params, sort_keys=True)
        rows.append(row)
        table = df.sparkSession.createDataFrame(counts.withColumn("model", F.lit(name)).toArrow())
        confusions = table if confusions is None else confusions.unionByName(table)
        scored.unpersist()
    best = max(rows, key=lambda r: r[select_by])
    return Run(best["model"], best[select_by], searches[best["model"]].model,
               _metrics_frame(df, rows, select_by, False), confusions, searches, roles,
               df.select(*roles.columns).schema, classes)


def train_regressors(
    df: DataFrame, target: str, key: Column, models: Sequence[str] = ("linear", "ridge", "lasso"),
    drop: Sequence[str] = (), grids: Mapping[str, Mapping] | None = None, folds: int = 3, seed: int = 42,
    test: float = 0.2, val: float = 0.2, select_by: str = "test_rmse", parallelism: int = 2, roles: Roles | None = None,
) -> Run:
    """Split, tune, fit and compare regressors; the best has the lowest ``select_by``."""
    _check(models, REGRESSORS)
    use_checkpoints(df.sparkSession)
    grids = grids or presets.REGRESSOR_GRIDS
    known = df.where(F.col(target).isNotNull())
    roles = roles or infer_roles(without(df, [target, *drop]))
    parts, train = _partitioned(known, key, roles.columns, target, None, folds, seed, test, val, _tuned(models, grids))
    trainer = Trainer(roles, target, None, seed, parallelism)
    searches = trainer.search({m: grids.get(m, {}) for m in models}, train, "_fold", folds)
    rows = []
    for name, found in searches.items():
        scored = found.model.transform(trainer.labelled(parts.where(F.col("_part") != "train")))
        row = {"model": name}
        for r in regression_metrics(scored, "label", "prediction", ["_part"]).collect():
            row |= {f"{r['_part']}_{m}": r[m] for m in ("mae", "rmse", "r2")}
        row["best_params"] = json.dumps(found.params, sort_keys=True)
        rows.append(row)
    best = min(rows, key=lambda r: r[select_by])
    return Run(best["model"], best[select_by], searches[best["model"]].model,
               _metrics_frame(df, rows, select_by, True), None, searches, roles, df.select(*roles.columns).schema)


@dataclass(frozen=True)
class Experiment:
    """A target and the columns that must not be used to predict it."""

    name: str
    target: str
    drop: tuple[str, ...] = ()


#: The three experiments that are compared.
EXPERIMENTS = (
    Experiment("original", "insurance_quality", ("insurance_quality",)),
    Experiment("high_risk", "is_high_risk", ("is_high_risk",)),
    Experiment("removed_stuff", "insurance_quality", ("insurance_quality", "is_high_risk", "risk_score")),
)


def learning_curves(
    df: DataFrame, experiments: Sequence[Experiment], key: Column,
    models: Mapping[str, Mapping] = presets.CURVE_MODELS, fractions: Sequence[float] = tuple(presets.CURVE_FRACTIONS),
    folds: int = 3, fit_rows: int | None = None, seed: int = 42, parallelism: int = 2,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Accuracy on growing training sets, as mean and population deviation over the folds.

    One row per experiment, model and training size. ``fit_rows`` bounds the largest training
    set; accuracy is always measured on all rows of the held-out fold.
    """
    use_checkpoints(df.sparkSession)
    results: list[dict] = []
    for e in experiments:
        roles = infer_roles(without(df, [e.target, *e.drop, *exclude]))
        known = written(df.where(F.col(e.target).isNotNull()).select(
            *roles.columns, e.target, key_hash(key, seed).alias("_place")), "curves")
        data = sampling.folds(known, F.col("_place"), folds, None, e.target, "_fold")
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            classes = classes_of(data, e.target)
            steps = sampling.nested_prefixes(data, F.col("_place"), fractions, None, "_fold", folds, most=fit_rows)
            trainer = Trainer(roles, e.target, classes, seed)

            def one_size(step: dict) -> list[dict]:
                train = data.where((F.col("_fold") != step["fold"]) & (F.col("_place") < step["cut"]))
                held = data.where(F.col("_fold") == step["fold"])
                prepared = trainer.prepare(train)
                ready = [trainer.prepared_rows(prepared, part) for part in (train, held)]
                found = []
                try:
                    for name, params in models.items():
                        learner = trainer.build(name, params).fit(ready[0])
                        on_train, on_held = (trainer.accuracy(learner.transform(part)) for part in ready)
                        found.append({"experiment": e.name, "model": name, "fold": step["fold"],
                                      "train_size": step["size"], "train_accuracy": on_train, "val_accuracy": on_held})
                finally:
                    for part in ready:
                        part.unpersist()
                return found

            with ThreadPoolExecutor(parallelism) as pool:
                for found in pool.map(one_size, steps):
                    results += found
        finally:
            data.unpersist()
    folds_table = df.sparkSession.createDataFrame(pa.Table.from_pylist(results))
    return summarise_curves(folds_table)


def summarise_curves(by_fold: DataFrame) -> DataFrame:
    return by_fold.groupBy("experiment", "model", "train_size").agg(
        F.avg("train_accuracy").alias("train_mean"), F.stddev_pop("train_accuracy").alias("train_std"),
        F.avg("val_accuracy").alias("val_mean"), F.stddev_pop("val_accuracy").alias("val_std"))


def run_experiments(df: DataFrame, experiments: Sequence[Experiment], key: Column,
                    train: Callable[..., Run] = train_classifiers, **options) -> tuple[DataFrame, DataFrame]:
    """The same training job for several targets and drop lists: metrics and confusions."""
    metrics, confusions = None, None
    for e in experiments:
        run = train(df, e.target, key, drop=e.drop, **options)
        named = [t.withColumn("experiment", F.lit(e.name)) for t in (run.metrics, run.confusions)]
        metrics = named[0] if metrics is None else metrics.unionByName(named[0], allowMissingColumns=True)
        confusions = named[1] if confusions is None else confusions.unionByName(named[1])
    return metrics, confusions
