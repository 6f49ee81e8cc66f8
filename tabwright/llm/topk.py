"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of candidates and of one block of queries.
CANDIDATE_ROWS = 4096
QUERY_ROWS = 2048
#: Entries taken from every list between two tests of the stopping rule.
STEP = 64

_RESULT = "query_id long, vec_id long, score long"


def threshold_top_k(query: np.ndarray, query_id: int, vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, step: int = STEP) -> list[tuple[int, int]]:
    """The ``k`` best ``(score, id)`` of one block, ties to the smaller id.

    ``lists[d]`` holds the row numbers by ascending component ``d``. A list is read from the end that the sign of the query's
    component makes best, dimensions in which the query is 0 are not read. After every ``step`` entries of all lists, a row
    not met yet scores at most ``bound``, the sum of the products at the lists' current places; reading stops when the kth
    score is above it. A bound that only equals the kth score reads on, since a smaller id could still tie.
    """
    rows = len(ids)
    used = np.flatnonzero(query)
    down, up = used[query[used] > 0], used[query[used] < 0]
    met = ids == query_id  # the query's own row
    left = rows - int(met.sum())
    scores, found = np.empty(0, vectors.dtype), np.empty(0, np.int64)
    depth = 0
    while left:
        upto = min(rows, depth + step) if len(used) else rows
        fresh = np.zeros(rows, bool)
        fresh[lists[down, rows - upto:rows - depth]] = True
        fresh[lists[up, depth:upto]] = True
        new = np.flatnonzero(fresh & ~met if len(used) else ~met)
        met[new] = True
        left -= len(new)
        depth = upto
        scores, found = np.concatenate([scores, vectors[new] @ query]), np.concatenate([found, ids[new]])
        if len(found) > k:
            # All that reach the kth score, then the order with ties.
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            best = near[np.lexsort((found[near], -scores[near]))[:k]]
            scores, found = scores[best], found[best]
        if len(found) == k and left:
            bound = vectors[lists[down, rows - depth - 1], down] @ query[down] + vectors[lists[up, depth], up] @ query[up]
            if scores.min() > bound:
                break
    best = np.lexsort((found, -scores))[:k]
    return [(int(scores[b]), int(found[b])) for b in best]


def _block(k: int):
    def run(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(queries) and len(candidates):
            ids = candidates["vec_id"].to_numpy(np.int64)
            vectors = np.stack(candidates["parts"].to_numpy()).astype(np.int64) if len(candidates["parts"].iloc[0]) else np.zeros((len(ids), 0), np.int64)
            targets = np.stack(queries["parts"].to_numpy()).astype(np.int64) if len(queries["parts"].iloc[0]) else np.zeros((len(queries), 0), np.int64)
            # Floating products are exact, and much faster, while every sum fits the mantissa.
            largest = max((float(np.abs(x).max()) for x in (vectors, targets) if x.size), default=0.0)
            for kind, limit in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
                if largest * largest * max(1, vectors.shape[1]) < limit:
                    vectors, targets = vectors.astype(kind), targets.astype(kind)
                    break
            lists = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
            for query_id, query in zip(queries["vec_id"].to_numpy(np.int64), targets):
                out += [(int(query_id), i, s) for s, i in threshold_top_k(query, int(query_id), vectors, ids, lists, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best candidates by integer inner product.

    Both tables have ``vec_id long`` and ``parts array<long>``. A candidate with the query's own id is left out. Rows with a null
    id or vector, or a null component, take no part; vectors meet only those of the same length; queries that repeat id and vector count once,
    and a candidate listed twice is found twice. Scores must fit a long.

    Queries and candidates are cut into blocks by hash, and every pair of blocks is one bounded task: the block's lists are
    sorted once and all queries of the query block run over them. Each block returns ``k`` rows per query; the best of them
    are the answer.
    """
    whole = "vec_id IS NOT NULL AND parts IS NOT NULL AND NOT exists(parts, x -> x IS NULL)"
    q = queries.filter(whole).select("vec_id", "parts", F.size("parts").alias("width")).dropDuplicates(["vec_id", "parts"])
    c = candidates.filter(whole).select("vec_id", "parts", F.size("parts").alias("width"))
    query_blocks = max(1, -(-q.count() // QUERY_ROWS))
    blocks = max(1, -(-c.count() // CANDIDATE_ROWS))
    block_of = lambda n, seed: F.pmod(F.xxhash64("vec_id", "parts", F.lit(seed)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", block_of(query_blocks, 1)).withColumn("cb", all_of(blocks))
    # Copies of one vector spread by their id.
    c = c.withColumn("cb", block_of(blocks, 2)).withColumn("qb", all_of(query_blocks))
    keys = ["width", "qb", "cb"]
    best = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(_block(k), _RESULT)
    # Two queries of one id (different vectors) answer as one.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, parts``: each component x becomes floor(scale * x); vectors holding null, NaN or infinity are left out."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"),
                                        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("parts"))
