"""Linear learners over folds from second moments: two passes over the rows, whatever the grid and the number of folds.

Preparing features is linear in raw columns: a filled and standardised number is a combination of the number, the mark of a
missing one and a constant, a 0/1 feature that of texts and their missing mark. One pass sums the products of these columns per fold. The
training moments of a fold are the total less that fold, its preparation and every penalty are solved from them, and the
held-out error is a quadratic form of the fold's own moments.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.features import as_number
from tabwright.operators.orderstats import quantiles
from tabwright.operators.roles import Roles

#: Learners that moments solve; their penalty makes the weights unique.
LINEAR = ("ridge", "lasso", "elasticnet")
#: Most raw columns; each fold has the square of so many numbers, which the driver holds.
MOST_COLUMNS = 256
#: A variance below this share of the mean square is rounding.
_ROUNDING = 1e-13


def solve(kind: str, params: Mapping, products: np.ndarray, cross: np.ndarray, n: float, sweeps: int = 10_000) -> np.ndarray:
    """Weights from centred ``products`` (X'X) and ``cross`` (X'y) of ``n`` rows.

    ridge minimises ``sum(err^2) + alpha |w|^2``; lasso and elastic net ``sum(err^2) / 2n + alpha (r |w|_1 + (1 - r) |w|^2 / 2)``.
    """
    alpha = float(params.get("alpha", 1.0))
    if alpha == 0.0:
        return np.linalg.lstsq(products, cross, rcond=1e-12)[0]
    if kind == "ridge":
        factor = np.linalg.cholesky(products + alpha * np.eye(len(products)))
        return np.linalg.solve(factor.T, np.linalg.solve(factor, cross))
    ratio = 1.0 if kind == "lasso" else float(params.get("l1_ratio", 0.5))
    weights, left = np.zeros(len(cross)), cross.copy()  # left: X' of the residuals
    diagonal = np.diag(products)
    for _ in range(sweeps):
        largest = 0.0
        for j in np.flatnonzero(diagonal > 0):
            pull = left[j] + diagonal[j] * weights[j]
            value = np.sign(pull) * max(abs(pull) - n * alpha * ratio, 0.0) / (diagonal[j] + n * alpha * (1.0 - ratio))
            change = value - weights[j]
            if change:
                left -= products[:, j] * change
                weights[j] = value
                largest = max(largest, abs(change) * np.sqrt(diagonal[j] / n))
        if largest <= 1e-11 * max(1.0, np.abs(weights).max()):
            break
    return weights


@dataclass
class FoldMoments:
    """Sums of products of the raw columns per fold, and what they stand for."""

    folds: np.ndarray  # fold x column x column; column 0 is the constant, the last one the target
    numbers: list[tuple[int, int | None, float]]  # per numeric column: its place, that of its missing mark, what was subtracted
    texts: list[tuple[dict[str, int], int | None]]  # per text column: place of every text, and of the missing mark
    others: list[int]  # places of columns that are passed through
    medians: Mapping[tuple[int, int], float]  # per fold and numeric column with missing values

    def _prepared(self, fold: int, train: np.ndarray) -> np.ndarray:
        """Raw columns to constant, features and target, as fitted on the rows outside ``fold``."""
        n, width = train[0, 0], len(train)
        columns = [np.eye(width)[0]]
        for j, (place, mark, shift) in enumerate(self.numbers):
            filled = np.zeros(width)
            filled[place] = 1.0
            if mark is not None:
                filled[mark] = self.medians.get((fold, j), 0.0) - shift
            mean = train[0] @ filled / n
            square = filled @ train @ filled / n
            variance = square - mean * mean
            filled[0] = -mean
            columns.append(filled / (np.sqrt(variance) if variance > _ROUNDING * square else 1.0))
        for places, mark in self.texts:
            counts = {text: train[0, p] for text, p in places.items()}
            mode = min(counts, key=lambda text: (-counts[text], text), default=None)
            for text in sorted(places):
                fills = mark is not None and text == mode
                if counts[text] > 0:
                    column = np.eye(width)[places[text]]
                    if fills:
                        column[mark] = 1.0
                    columns.append(column)
        columns += [np.eye(width)[p] for p in self.others]
        return np.array([*columns, np.eye(width)[-1]]).T

    def scores(self, jobs: Sequence[tuple[str, Mapping]]) -> list[list[float]]:
        """Per job (learner and parameters): the negative root mean squared error on every fold."""
        total = self.folds.sum(0)
        found: list[list[float]] = [[] for _ in jobs]
        for f, own in enumerate(self.folds):
            basis = self._prepared(f, total - own)
            train, held = (basis.T @ part @ basis for part in (total - own, own))
            n = train[0, 0]
            means = train[0] / n
            centred = train - n * np.outer(means, means)
            for scores, (kind, params) in zip(found, jobs):
                weights = solve(kind, params, centred[1:-1, 1:-1], centred[1:-1, -1], n)
                error = np.concatenate([[means[1:-1] @ weights - means[-1]], -weights, [1.0]])
                scores.append(-float(np.sqrt(max(error @ held @ error, 0.0) / held[0, 0])))
        return found


def _products(width: int, numeric: int, sizes: Sequence[int], marked: Sequence[bool], text_marked: Sequence[bool], k: int):
    """Sums of products of one task, one row per fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width, width))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                rows = part.num_rows
                values = np.zeros((rows, width))
                values[:, 0] = 1.0
                at = 1
                for j in range(numeric):
                    column = np.asarray(part.column(1 + j).to_numpy(zero_copy_only=False), np.float64)
                    if marked[j]:
                        missing = np.asarray(part.column(1 + j).is_null())
                        values[:, at + 1] = missing
                        column = np.where(missing, 0.0, column)
                    values[:, at] = column
                    at += 1 + marked[j]
                for j, size in enumerate(sizes):
                    codes = np.asarray(part.column(1 + numeric + j))
                    values[np.arange(rows), at + codes] = 1.0
                    at += size + text_marked[j]
                for j in range(1 + numeric + len(sizes), part.num_columns):
                    values[:, at] = np.asarray(part.column(j).to_numpy(zero_copy_only=False), np.float64)
                    at += 1
                folds = np.asarray(part.column(0))
                for f in np.unique(folds).tolist():
                    own = values[folds == f]
                    sums[f] += own.T @ own
        for f in range(k):
            if sums[f, 0, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([sums[f].ravel()], pa.list_(pa.float64()))], ["fold", "sums"])

    return run


def fold_moments(train: DataFrame, roles: Roles, target: str, fold: str, k: int, most: int | None = None) -> FoldMoments | None:
    """Moments of the columns of ``roles`` and a numeric ``target`` per fold (0 to ``k - 1``).

    None where moments cannot serve: more than ``most`` raw columns (``MOST_COLUMNS``), an empty fold, a fold that holds all rows, or a
    target or passed-through column with missing or non-finite values. One pass finds ranges and missing values, one the texts, one
    sums the products, and columns with missing numbers take that of their medians.
    """
    most = MOST_COLUMNS if most is None else most
    number = {c: as_number(c) for c in roles.numeric}
    plain = {c: F.col(c).cast("double") for c in [*roles.passthrough, target]}
    if len(number) + len(roles.categorical) + len(plain) >= most:
        return None
    seen = train.agg(F.count(F.lit(1)), *[f(x) for x in [*number.values(), *plain.values()] for f in (F.count, F.avg)],
                     *[F.count(c) for c in roles.categorical]).first()
    rows, counts = seen[0], {c: (seen[1 + 2 * j], seen[2 + 2 * j]) for j, c in enumerate([*number, *plain])}
    if any(counts[c][0] < rows for c in plain) or any(m is not None and not np.isfinite(m) for _, m in counts.values()):
        return None
    known = dict(zip(roles.categorical, seen[1 + 2 * len(counts):]))
    texts: dict[str, list[str]] = {c: [] for c in roles.categorical}
    if texts:
        values = train.select(*[F.col(c).cast("string").alias(c) for c in texts]).unpivot([], list(texts), "feature", "value")
        for r in values.where(F.col("value").isNotNull()).distinct().limit(most).collect():
            texts[r["feature"]].append(r["value"])
    marked = [counts[c][0] < rows for c in number]
    text_marked = [known[c] < rows for c in texts]
    width = 1 + len(number) + sum(marked) + sum(map(len, texts.values())) + sum(text_marked) + len(plain)
    if width > most:
        return None

    columns = [F.col(fold).cast("int").alias("fold")]
    columns += [(x - F.lit(counts[c][1] or 0.0)).alias(f"n{j}") for j, (c, x) in enumerate(number.items())]
    for j, (c, found) in enumerate(texts.items()):
        found.sort()
        codes = F.create_map(*[x for code, text in enumerate(found) for x in (F.lit(text), F.lit(code))]) if found else None
        code = F.lit(0) if codes is None else F.coalesce(codes[F.col(c).cast("string")], F.lit(len(found)))
        columns.append(code.cast("int").alias(f"c{j}"))
    columns += [(x - F.lit(counts[c][1] or 0.0)).alias(f"p{j}") for j, (c, x) in enumerate(plain.items())]
    run = _products(width, len(number), [len(v) for v in texts.values()], marked, text_marked, k)
    summed = train.select(*columns).mapInArrow(run, "fold int, sums array<double>").select("fold", F.posexplode("sums").alias("i", "v"))
    sums = np.zeros((k, width * width))
    for r in summed.groupBy("fold", "i").agg(F.sum("v").alias("v")).toArrow().to_pylist():
        sums[r["fold"], r["i"]] = r["v"]
    sums = sums.reshape(k, width, width)
    held = sums[:, 0, 0]
    if not held.all() or held.max() == held.sum() or not np.isfinite(sums).all():
        return None

    place, numbers = 1, []
    for c, m in zip(number, marked):
        numbers.append((place, place + 1 if m else None, counts[c][1] or 0.0))
        place += 1 + m
    places = []
    for (c, found), m in zip(texts.items(), text_marked):
        places.append(({text: place + j for j, text in enumerate(found)}, place + len(found) if m else None))
        place += len(found) + m
    others = list(range(place, place + len(roles.passthrough)))
    medians: dict[tuple[int, int], float] = {}
    gaps = [c for c, m in zip(number, marked) if m]
    if gaps:
        order = list(number)
        away = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))
        for r in quantiles(train.select(F.explode(away).alias("held_"), *gaps), gaps, [0.5], by=["held_"]).collect():
            if r["q0"] is not None:
                medians[r["held_"], order.index(r["feature"])] = r["q0"]
    return FoldMoments(sums, numbers, places, others, medians)
