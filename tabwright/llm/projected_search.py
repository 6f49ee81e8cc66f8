"""Approximate nearest neighbours by few stable projections in a kd-tree, verified until a chi-square test stops the search.

The squared length of PROJECTIONS Gaussian projections of a difference of vectors, over its squared distance, follows the chi-square law
with as many degrees of freedom. A query meets candidates in order of their projected distance and computes true ones;
once the next projected distance is one that a nearer vector than the present k-th would exceed with a probability of at most
``1 - CONFIDENCE``, it stops. The upper levels of the kd-tree deal the vectors into cells, which tasks search on their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.storage import written

#: Projections (an even number), and the share of true neighbours that the stopping test is to find.
PROJECTIONS = 8
CONFIDENCE = 0.98
#: The upper kd-tree is fitted on at most so many vectors, with at least so many of them in a cell.
SAMPLE_VECTORS, SAMPLE_CELL = 16_384, 64
#: A cell of more vectors is searched in several parts.
CELL_VECTORS = 8_192
LEAF_VECTORS = 32

#: A kd-tree: the number of a cell, or axis, border, and the trees below and from the border on.
Tree = int | tuple[int, float, "Tree", "Tree"]


def chi_square_limit(confidence: float, degrees: int) -> float:
    """The value that a chi-square variable of an even number of ``degrees`` stays below with probability ``confidence``."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))
        low, high = (x, high) if 1 - tail < confidence else (low, x)
    return high


def projections(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, PROJECTIONS))


def grown(points: np.ndarray, least: int, cells: Iterator[int]) -> Tree:
    """A kd-tree of the widest axis and its median, down to cells of ``least`` to ``2 * least - 1`` points or of equal ones."""
    if len(points) >= 2 * least:
        for axis in np.argsort(points.min(0) - points.max(0)).tolist():
            border = float(np.median(points[:, axis]))
            below = points[:, axis] < border
            if below.any():
                return axis, border, grown(points[below], least, cells), grown(points[~below], least, cells)
    return next(cells)


def cells_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    found = np.empty(len(points), np.int32)

    def fill(tree: Tree, at: np.ndarray) -> None:
        if isinstance(tree, int):
            found[at] = tree
        elif len(at):
            axis, border, below, above = tree
            left = points[at, axis] < border
            fill(below, at[left])
            fill(above, at[~left])

    fill(tree, np.arange(len(points)))
    return found


def box_distances(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of ``point`` from boxes."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(1)


class Cell:
    """Vectors of one part of a cell, in the leaves of a kd-tree of their projections."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray, ids: list[list[int]]) -> None:
        leaves = cells_of(grown(projected, LEAF_VECTORS, iter(range(len(projected)))), projected)
        order = np.argsort(leaves, kind="stable")
        self.vectors, self.projected, self.ids = vectors[order], projected[order], [ids[k] for k in order]
        self.starts = np.flatnonzero(np.diff(leaves[order], prepend=-1))
        self.ends = np.append(self.starts[1:], len(order))
        self.low, self.high = np.minimum.reduceat(self.projected, self.starts), np.maximum.reduceat(self.projected, self.starts)

    def nearest(self, vector: np.ndarray, projected: np.ndarray, bound: float, k: int, limit: float) -> list[tuple[float, int]]:
        """Of the ids verified, the ``k`` with the smallest ``(distance, id)``; ``bound`` is a k-th distance known before."""
        boxes = box_distances(self.low, self.high, projected)
        waiting: list[tuple[float, int]] = []
        best: list[tuple[float, int]] = []
        leaves = np.argsort(boxes, kind="stable").tolist()
        for place, leaf in enumerate(leaves):
            if boxes[leaf] > limit * bound * bound:
                break
            span = slice(self.starts[leaf], self.ends[leaf])
            away = ((self.projected[span] - projected) ** 2).sum(1)
            for item in zip(away.tolist(), range(span.start, span.stop)):
                heapq.heappush(waiting, item)
            # What lies nearer than the next leaf comes next in the order of projected distance.
            border = boxes[leaves[place + 1]] if place + 1 < len(leaves) else math.inf
            ready = []
            while waiting and waiting[0][0] <= min(border, limit * bound * bound):
                ready.append(heapq.heappop(waiting)[1])
            if ready:
                distances = np.sqrt(((self.vectors[ready] - vector) ** 2).sum(1))
                best += [(d, i) for d, at in zip(distances.tolist(), ready) if d <= bound for i in self.ids[at]]
                if len(best) >= k:
                    best = heapq.nsmallest(k, best)
                    bound = min(bound, best[-1][0])
        return heapq.nsmallest(k, best)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _projected(seed: int, trees: dict[int, Tree]):
    """Projections and cell of every vector; lengths without a tree are one cell each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("dims"))
            for dims in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dims))
                points = _matrix(part.column("vector")) @ projections(dims, seed)
                cells = cells_of(trees.get(dims, 0), points)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(points), pa.array(cells)], [*part.schema.names, "projected", "cell"])

    return run


def _searched(k: int, limit: float):
    """Rows sorted by cell and part, candidates first: queries stream past the candidates of their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cell = None, [], None
        for batch in batches:
            parts = list(zip(*(batch.column(c).to_pylist() for c in ("dims", "cell", "part"))))
            cuts = [0, *(n for n in range(1, len(parts)) if parts[n] != parts[n - 1]), len(parts)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if parts[start] != key:
                    key, held, cell = parts[start], [], None
                rows = batch.slice(start, end - start)
                query = np.asarray(rows.column("is_query").to_numpy(zero_copy_only=False))
                if not query.all():
                    held.append(rows.filter(pa.array(~query)))
                asked = rows.filter(pa.array(query))
                if not len(asked) or not held:
                    continue
                if cell is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    columns = [table.column(c).combine_chunks() for c in ("vector", "projected", "ids")]
                    cell = Cell(_matrix(columns[0]), _matrix(columns[1]), columns[2].to_pylist())
                vectors, points = _matrix(asked.column("vector")), _matrix(asked.column("projected"))
                found = [(q, d, i) for q, v, p, b in zip(asked.column("query").to_pylist(), vectors, points, asked.column("bound").to_pylist())
                         for d, i in cell.nearest(v, p, math.inf if b is None else b, k, limit)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64()),
                                                  pa.array([f[2] for f in found], pa.int64())], ["query", "distance", "vec_id"])

    return run


def _routed(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], limit: float):
    """A row per query and cell, other than its own, whose box the stopping test does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, cells = [], []
            for n, (dims, own, point, bound) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dims", "cell", "projected", "bound")))):
                if dims in boxes:
                    numbers, low, high = boxes[dims]
                    near = numbers[box_distances(low, high, np.array(point)) <= (math.inf if bound is None else limit * bound * bound)]
                    near = near[near != own]
                    places += [n] * len(near)
                    cells += near.tolist()
            rows = batch.take(pa.array(places, pa.int64()))
            yield rows.set_column(rows.schema.get_field_index("cell"), "cell", pa.array(cells, pa.int32()))

    return run


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, dims, vector``, once each, of vectors with finite components that are not all zero."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))) & F.exists(vector, lambda x: x != 0)
    # Adding 0 makes -0 one with 0.
    rows = table.filter(F.col("vec_id").isNotNull() & fits).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size(vector).alias("dims"), F.transform(vector, lambda x: x.cast("double") + 0.0).alias("vector"))
    return rows.distinct()


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, confidence: float = CONFIDENCE, seed: int = 12,
            sample: int = SAMPLE_VECTORS, sample_cell: int = SAMPLE_CELL, cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries``, the ``k`` nearest rows of ``candidates`` found.

    Both hold ``vec_id`` and a list of numbers ``embedding``. ``score`` is the Euclidean distance of the whole vectors in double precision; ranks start at 1, nearest
    first, ties go to the smaller vec_id. A true neighbour is missed with a probability of at most about ``1 - confidence``. With fewer than
    ``k`` candidates all are returned. A query's own row (the same id and vector) is no answer to it. Null or zero vectors, those with
    null or non-finite components, and rows without an id take no part; rows that repeat an id and a vector count once; vectors of
    different lengths never meet. Empty tables give an empty result; other columns are ignored, whatever their names.

    Vectors that repeat are one point with their ``k + 1`` smallest ids. The upper tree is fitted on a sample of at most ``sample`` distinct
    vectors (those with the smallest hash); every vector is indexed. A query first searches its own cell, then, with the k-th
    distance found, the cells whose boxes of projections the test does not rule out. Only queries travel between cells; a task holds
    ``cell_vectors`` candidates at a time on average, however large their cell is.
    """
    limit, most = chi_square_limit(confidence, PROJECTIONS), k + 1
    asked = written(usable(queries), "search-asked")
    smallest = Window.partitionBy("dims", "vector").orderBy("vec_id")
    points = usable(candidates).withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= most)
    points = written(points.groupBy("dims", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "search-points")
    # About twice the sample, by hash, is all that the sort for it sees.
    share = min(1.0, 2 * sample / max(points.count(), 1))
    lowest = F.pmod(F.xxhash64("vector"), F.lit(1 << 32)) < int(share * (1 << 32))
    drawn = points.select("dims", "vector").filter(lowest).orderBy(F.xxhash64("vector"), "vector").limit(sample).toArrow()
    trees: dict[int, Tree] = {}
    lengths = np.asarray(drawn.column("dims"))
    for dims in np.unique(lengths).tolist():
        part = drawn.filter(pa.array(lengths == dims)).column("vector").combine_chunks()
        trees[dims] = grown(_matrix(part) @ projections(dims, seed), sample_cell, iter(range(sample)))

    place = _projected(seed, trees)
    indexed = written(points.mapInArrow(place, "dims int, vector array<double>, ids array<long>, projected array<double>, cell int"), "search-indexed")
    low, high = [F.array(*[of(F.get("projected", F.lit(j))) for j in range(PROJECTIONS)]) for of in (F.min, F.max)]
    sizes = indexed.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("vectors"), low.alias("low"), high.alias("high"))
    sizes = written(sizes.withColumn("parts", F.ceil(F.col("vectors") / cell_vectors).cast("int")), "search-cells")
    # At most one cell per SAMPLE_CELL sampled vectors of a length; a length outside the sample has its own cell only.
    boxes = {}
    cells = sizes.filter(F.col("dims").isin(list(trees))).select("dims", "cell", "low", "high").toArrow()
    of_cells = np.asarray(cells.column("dims"))
    for dims in trees:
        part = cells.filter(pa.array(of_cells == dims))
        boxes[dims] = (np.asarray(part.column("cell")), *(_matrix(part.column(c).combine_chunks()) for c in ("low", "high")))

    wanted = asked.select("dims", "vector").distinct().withColumn("query", F.monotonically_increasing_id())
    wanted = written(wanted, "search-queries").mapInArrow(place, "dims int, vector array<double>, query long, projected array<double>, cell int")
    wanted = written(wanted, "search-wanted")
    parts = sizes.select("dims", "cell", "parts")
    dealt = indexed.join(parts, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("vector"), "parts").cast("int"))
    nothing = {"query": F.lit(None).cast("long"), "bound": F.lit(None).cast("double"), "ids": F.lit(None).cast("array<long>")}
    columns = ["dims", "cell", "part", "is_query", "query", "vector", "projected", "bound", "ids"]

    def answers(routes: DataFrame, name: str) -> DataFrame:
        """The ``most`` best of every query, of all parts of the cells that ``routes`` names."""
        sent = routes.join(parts, ["dims", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = dealt.withColumns({"is_query": F.lit(False), "query": nothing["query"], "bound": nothing["bound"]}).select(columns)
        rows = rows.union(sent.withColumns({"is_query": F.lit(True), "ids": nothing["ids"]}).select(columns))
        rows = rows.repartition("dims", "cell", "part").sortWithinPartitions("dims", "cell", "part", "is_query")
        found = rows.mapInArrow(_searched(most, limit), "query long, distance double, vec_id long")
        order = Window.partitionBy("query").orderBy("distance", "vec_id")
        return written(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place"), name)

    home = answers(wanted.withColumn("bound", nothing["bound"]), "search-home")
    bounds = home.groupBy("query").agg(F.when(F.count(F.lit(1)) >= most, F.max("distance")).alias("bound"))
    routes = wanted.join(bounds, "query", "left").select("dims", "vector", "query", "projected", "cell", "bound")
    routes = written(routes.mapInArrow(_routed(boxes, limit), routes.schema), "search-routes")
    found = home.unionByName(answers(routes, "search-away"))
    best = written(found.groupBy("query").agg(F.collect_list(F.struct("distance", "vec_id")).alias("found")), "search-found")
    named = wanted.select("dims", "vector", "query").join(best, "query").select("dims", "vector", "found")
    # A vector that many queries share meets one row of answers.
    each = asked.join(named.hint("merge"), ["dims", "vector"]).select(F.col("vec_id").alias("query_id"), "vector", F.explode("found").alias("hit"))
    own = (F.col("hit.vec_id") == F.col("query_id")) & (F.col("hit.distance") == 0)
    order = Window.partitionBy("query_id", "vector").orderBy("score", "vec_id")
    each = each.filter(~own).select("query_id", "vector", F.col("hit.vec_id").alias("vec_id"), F.col("hit.distance").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
