"""Reproducible splits, folds and subsamples from hashed row keys.

A row's place follows from its key and a seed alone, so it survives repartitioning, retries and
appended rows. Exact sizes come from order statistics of the hash, which give one cut per
stratum; assigning rows is then a projection. Copies of one key always stay together.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.hashing import HASH_RANGE, key_hash, key_uniform
from tabwright.operators.orderstats import ROW_LIMIT, order_statistics, value_sizes
from tabwright.operators.running import running_totals
from tabwright.storage import side_table, written

PARTS = ("train", "val", "test")
#: Cells of the hash range in which the cuts of nested training sets are looked for.
PREFIX_CELLS = 16_384
#: Up to so many strata are apportioned on the driver and their cuts written into the expression; more stay a table from end to end.
LITERAL_STRATA = 1_000


def _place(key: Column, seed: int | None) -> Column:
    """Place of a row in the random order. With ``seed=None`` the key is such a place already."""
    return key if seed is None else key_hash(key, seed)


def random_split(df: DataFrame, key: Column, seed: int = 42, test: float = 0.2, val: float = 0.2,
                 output: str = "part") -> DataFrame:
    """Assign train, val and test in the expected proportions, without a shuffle."""
    u = key_uniform(key, seed)
    return df.withColumn(output, F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def allocate(sizes: Mapping, total: int) -> dict:
    """Split ``total`` over strata in proportion to their sizes, largest remainders first."""
    n = sum(sizes.values())
    shares = {k: total * size / n for k, size in sizes.items()}
    given = {k: math.floor(s) for k, s in shares.items()}
    order = sorted(sizes, key=lambda k: (given[k] - shares[k], str(k)))
    for k in order[: total - sum(given.values())]:
        given[k] += 1
    return given


def _strata(df: DataFrame, key: Column, seed: int | None, stratum: str | None) -> tuple[DataFrame, list | DataFrame]:
    """Places of the rows, and size and range per stratum: rows for up to ``LITERAL_STRATA`` strata, else a written table."""
    label = F.col(stratum).cast("string") if stratum else F.lit("all")
    values = df.select(label.alias("stratum"), _place(key, seed).alias("value"))
    sizes, few = side_table(value_sizes(values, ["stratum"]), "strata", LITERAL_STRATA)
    if not sizes.where(F.col("stratum").isNull()).isEmpty():
        raise ValueError(f"{stratum!r} has missing values; a stratum must be known")
    return values, sorted(sizes.collect(), key=lambda r: r["stratum"]) if few else sizes


def _in_order(table: DataFrame, order: list[Column], value: str) -> DataFrame:
    """Add ``rank`` (from 1) and ``before``, the total of ``value`` in earlier rows, to a table of any length in a unique order."""
    ranged = written(table.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ordered")
    within = Window.partitionBy("part_").orderBy(*order)
    totals = ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("rows_"), F.sum(value).alias("sum_"))
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("part_", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("rows_", "sum_")])
    placed = ranged.withColumns({"rank": F.row_number().over(within), "before": F.sum(value).over(within) - F.col(value)})
    return placed.join(F.broadcast(offsets), "part_").withColumns({"rank": F.col("rank") + F.col("rows_"), "before": F.col("before") + F.col("sum_")}).drop(
        "part_", "rows_", "sum_")


def _apportioned(sizes: DataFrame, size: str, total: int, output: str) -> DataFrame:
    """``allocate`` for a table of strata: ``total`` split in proportion to ``size``, largest remainders first, in exact arithmetic."""
    n = sizes.agg(F.sum(size)).first()[0]
    product = F.col(size).cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    shared = sizes.withColumn("product_", product)
    shared = shared.withColumn(output, F.expr(f"product_ div CAST({max(n, 1)} AS DECIMAL(19, 0))"))
    shared = shared.withColumn("left_", F.expr(f"CAST(product_ - CAST({output} AS DECIMAL(19, 0)) * CAST({max(n, 1)} AS DECIMAL(19, 0)) AS BIGINT)")).drop("product_")
    ranked = written(_in_order(shared, [F.col("left_").desc(), F.col("stratum")], output), "apportioned")
    more = total - (ranked.agg(F.sum(output)).first()[0] or 0)
    return ranked.withColumn(output, F.col(output) + (F.col("rank") <= more).cast("bigint")).drop("rank", "before", "left_")


def _joined_cuts(df: DataFrame, values: DataFrame, sizes: DataFrame, stratum: str, positions: Sequence[str], names: Sequence[str],
                 row_limit: int) -> DataFrame:
    """Add to every row the hash values at ``positions`` (columns of ``sizes``) of its stratum, joined from a table."""
    asked = F.array_sort(F.array_distinct(F.filter(F.array(*positions), lambda p: p < F.col("n"))))
    requests = sizes.select("stratum", "n", "lo", "hi", asked.alias("positions")).where(F.size("positions") > 0)
    found = order_statistics(values, ["stratum"], requests, row_limit).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("at_"))  # at most one entry per name
    cuts = sizes.join(found.hint("merge"), "stratum", "left").select(F.col("stratum").alias("stratum_"), *[
        F.when(F.col(p) >= F.col("n"), F.lit(HASH_RANGE)).otherwise(F.col("at_")[F.col(p)]).cast("bigint").alias(name) for p, name in zip(positions, names)])
    # Written, so that the join reads plain shuffles and a large stratum can be split between tasks.
    return df.join(written(cuts, "cuts").hint("merge"), F.col(stratum).cast("string") == F.col("stratum_")).drop("stratum_")


def hash_cuts(values: DataFrame, rows: Sequence, positions: Mapping[str, Sequence[int]],
              row_limit: int = ROW_LIMIT) -> dict[str, dict[int, int]]:
    """Hash values that have exactly ``position`` smaller ones within their stratum.

    A position at or past the end has no such value and gets the upper limit of the hash.
    """
    sizes = {r["stratum"]: r["n"] for r in rows}
    cuts = {k: {p: HASH_RANGE for p in positions.get(k, ()) if p >= n} for k, n in sizes.items()}
    wanted = [(r["stratum"], r["n"], r["lo"], r["hi"], sorted({p for p in positions.get(r["stratum"], ())
                                                              if p < r["n"]})) for r in rows]
    wanted = [w for w in wanted if w[4]]
    if wanted:
        names = ["stratum", "n", "lo", "hi", "positions"]
        requests = values.sparkSession.createDataFrame(
            pa.Table.from_pylist([dict(zip(names, w)) for w in wanted]))
        for r in order_statistics(values, ["stratum"], requests, row_limit).collect():
            cuts[r["stratum"]][r["position"]] = r["value"]
    return cuts


def _with_cuts(df: DataFrame, stratum: str | None, cuts: Mapping[str, Sequence[int]], names: Sequence[str]) -> DataFrame:
    """Add the cuts of each row's stratum, at most ``LITERAL_STRATA`` of them, as literals."""
    if stratum is None:
        return df.withColumns({n: F.lit(c).cast("bigint") for n, c in zip(names, cuts["all"])})
    text = F.col(stratum).cast("string")
    pairs = [x for k, c in cuts.items() for x in (F.lit(k), F.array(*[F.lit(v).cast("bigint") for v in c]))]
    found = F.create_map(*pairs)[text]
    return df.withColumns({n: found[i] for i, n in enumerate(names)})


def exact_split(df: DataFrame, key: Column, seed: int | None = 42, test: float = 0.2, val: float = 0.2,
                stratum: str | None = None, output: str = "part",
                row_limit: int = ROW_LIMIT) -> DataFrame:
    """Assign train, val and test with exact sizes, optionally with equal shares per stratum.

    The test part is rounded up first, then the validation part of what remains.
    """
    values, rows = _strata(df, key, seed, stratum)
    table = isinstance(rows, DataFrame)
    if not table and not rows:
        return df.withColumn(output, F.lit("train"))
    sizes = {} if table else {r["stratum"]: r["n"] for r in rows}
    n = rows.agg(F.sum("n")).first()[0] if table else sum(sizes.values())
    n_test = math.ceil(test * n)
    n_val = math.ceil(round(val / (1.0 - test) * (n - n_test), 6))
    h = _place(key, seed)
    if table:
        given = _apportioned(rows, "n", n_test, "tests").withColumn("rest", F.col("n") - F.col("tests"))
        given = _apportioned(given, "rest", n_val, "vals").withColumn("end", F.col("tests") + F.col("vals"))
        cut = _joined_cuts(df, values, given, stratum, ["tests", "end"], ["_first", "_second"], row_limit)
    else:
        tests = allocate(sizes, n_test)
        vals = allocate({k: sizes[k] - tests[k] for k in sizes}, n_val)
        positions = {k: (tests[k], tests[k] + vals[k]) for k in sizes}
        cuts = hash_cuts(values, rows, positions, row_limit)
        cut = _with_cuts(df, stratum, {k: [cuts[k][p] for p in positions[k]] for k in sizes}, ["_first", "_second"])
    part = F.when(h < F.col("_first"), "test").when(h < F.col("_second"), "val").otherwise("train")
    return cut.withColumn(output, part).drop("_first", "_second")


def subsample(df: DataFrame, key: Column, n: int, seed: int | None = 42, stratum: str | None = None,
              row_limit: int = ROW_LIMIT) -> DataFrame:
    """Exactly ``n`` rows with the strata in proportion; a smaller table is returned whole.

    Where rows share the key that the cut falls on, the missing ones are taken among those rows by a hash of their content.
    """
    values, rows = _strata(df, key, seed, stratum)
    label = F.col(stratum).cast("string") if stratum else F.lit("all")
    if isinstance(rows, DataFrame):
        if rows.agg(F.sum("n")).first()[0] <= n:
            return df
        given = _apportioned(rows, "n", n, "taken")
        marked = _joined_cuts(df, values, given, stratum, ["taken"], ["_cut"], row_limit)
        marked = marked.join(given.select(F.col("stratum").alias("stratum_"), F.col("taken").alias("_taken")).hint("merge"), label == F.col("stratum_")).drop("stratum_")
    else:
        sizes = {r["stratum"]: r["n"] for r in rows}
        if sum(sizes.values()) <= n:
            return df
        taken = allocate(sizes, n)
        cuts = hash_cuts(values, rows, {k: (taken[k],) for k in sizes}, row_limit)
        marked = _with_cuts(df, stratum, {k: [cuts[k][taken[k]], taken[k]] for k in sizes}, ["_cut", "_taken"])
    marked = marked.withColumn("_h", _place(key, seed)).where(F.col("_h") <= F.col("_cut"))
    counts = marked.groupBy(label.alias("_stratum")).agg(
        F.count_if(F.col("_h") < F.col("_cut")).alias("_below"), F.first("_taken").alias("_wanted"))
    short, few = side_table(counts.where(F.col("_wanted") > F.col("_below")).select("_stratum", (F.col("_wanted") - F.col("_below")).alias("_short")), "short")
    helpers = ("_cut", "_taken", "_h")
    below = marked.where(F.col("_h") < F.col("_cut")).drop(*helpers)
    if few and short.isEmpty():
        return below
    # Only rows of the one key that a cut falls on are numbered.
    tied = marked.where(F.col("_h") == F.col("_cut")).drop(*helpers).join(short, label == F.col("_stratum"))
    place = F.row_number().over(Window.partitionBy("_stratum").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
    extra = tied.withColumn("_row", place).where(F.col("_row") <= F.col("_short")).drop("_row", "_short", "_stratum")
    return below.unionByName(extra)


def _fold_sizes(sizes: Mapping[str, int], k: int) -> dict[str, list[int]]:
    """Rows of each stratum per fold, so that strata and fold sizes are both balanced.

    The strata are laid end to end in label order and dealt out to the folds in turn.
    """
    dealt, start = {}, 0
    for stratum in sorted(sizes):
        n = sizes[stratum]
        dealt[stratum] = [len(range((fold - start) % k, n, k)) for fold in range(k)]
        start += n
    return dealt


def folds(df: DataFrame, key: Column, k: int = 3, seed: int | None = 42, stratum: str | None = None,
          output: str = "fold", row_limit: int = ROW_LIMIT) -> DataFrame:
    """Number the rows 0 to k-1 for cross-validation, in consecutive blocks of the hash order."""
    values, rows = _strata(df, key, seed, stratum)
    h = _place(key, seed)
    names = [f"_end{i}" for i in range(k - 1)]
    if isinstance(rows, DataFrame):
        dealt = _in_order(rows, [F.col("stratum")], "n")
        ends, end = {}, F.lit(0)
        for i in range(k - 1):
            # The rows at i - before, i - before + k, ... of a stratum.
            end = end + F.greatest(F.lit(0), F.expr(f"(n - pmod({i} - before, {k}) + {k - 1}) div {k}"))
            ends[f"end{i}"] = end
        cut = _joined_cuts(df, values, written(dealt.withColumns(ends), "fold-ends"), stratum, list(ends), names, row_limit)
    elif not rows:
        return df.withColumn(output, F.lit(0))
    else:
        sizes = _fold_sizes({r["stratum"]: r["n"] for r in rows}, k)
        ends = {s: [sum(blocks[: i + 1]) for i in range(k - 1)] for s, blocks in sizes.items()}
        cuts = hash_cuts(values, rows, ends, row_limit)
        cut = _with_cuts(df, stratum, {s: [cuts[s][e] for e in ends[s]] for s in ends}, names)
    fold = sum([(h >= F.col(n)).cast("int") for n in names], F.lit(0))
    return cut.withColumn(output, fold).drop(*names)


def random_row(df: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """One row, chosen by the smallest hash of its key."""
    return df.orderBy(_place(key, seed), key).limit(1)


def prefix_sizes(n: int, fractions: Sequence[float]) -> list[int]:
    """Distinct training sizes, ascending; fractions are rounded down."""
    return sorted({int(f * n) for f in fractions})


def nested_prefixes(df: DataFrame, key: Column, fractions: Sequence[float], seed: int | None = 42, fold: str = "fold",
                    k: int = 3, row_limit: int = ROW_LIMIT, most: int | None = None) -> list[dict]:
    """Cut points of growing training sets, each containing the smaller ones.

    For each fold, the training rows are those of the other folds in hash order. The result lists
    fold, size and cut; a training set is ``fold != f`` and ``key_hash < cut``. The sizes are
    fractions of the training set of the first fold, or of ``most`` rows where it is larger.

    One pass counts rows per fold and cell of the hash range, and a training set's count is the total less its fold; a second
    pass keeps the cells that hold a cut.
    """
    rows = df.select(F.col(fold).cast("int").alias("fold"), _place(key, seed).alias("value"))
    # A place is a hash, so cells of equal width hold about equally many rows.
    cell = F.expr(f"value div {-(-HASH_RANGE // PREFIX_CELLS)}").cast("int")
    counts = np.zeros((PREFIX_CELLS, k), np.int64)  # of bounded size, however many rows there are
    for r in rows.groupBy("fold", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist():
        counts[r["cell"], r["fold"]] = r["n"]
    trained = counts.sum(1, keepdims=True) - counts  # per cell, the rows that a fold is trained on
    ends = trained.cumsum(0)
    n = int(ends[-1, 0])
    sizes = prefix_sizes(n if most is None else min(n, most), fractions)
    wanted = [(f, s, int(np.searchsorted(ends[:, f], s, side="right"))) for f in range(k) for s in sizes if s < ends[-1, f]]
    cuts = {(f, s): HASH_RANGE for f in range(k) for s in sizes}
    if wanted:
        cells = sorted({c for _, _, c in wanted})
        inside = rows.withColumn("cell", cell).where(F.col("cell").isin(cells)).groupBy("cell", "value").agg(
            *[F.count_if(F.col("fold") != f).alias(f"n{f}") for f in range(k)])
        totals = running_totals(written(inside, "prefixes"), "value", {f"n{f}": F.sum(f"n{f}") for f in range(k)}, ["cell"], window_rows=row_limit)
        starts = df.sparkSession.createDataFrame([(c, f, s, s - int(ends[c - 1, f] if c else 0)) for f, s, c in wanted],
                                                 "cell int, held int, size bigint, place bigint")
        n_of, before = (F.array(*[F.col(f"n{f}{end}") for f in range(k)]) for end in ("", "_before"))
        found = totals.join(F.broadcast(starts), "cell").withColumns({"own": F.get(n_of, F.col("held")), "own_before": F.get(before, F.col("held"))})
        for r in found.where((F.col("place") >= F.col("own_before")) & (F.col("place") < F.col("own_before") + F.col("own"))).collect():
            cuts[r["held"], r["size"]] = r["value"]
    return [{"fold": f, "size": s, "cut": cuts[f, s]} for f in range(k) if ends[-1, f] for s in sizes]
