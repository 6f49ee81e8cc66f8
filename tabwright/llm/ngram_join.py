"""Exact Jaccard self-join of word shingles with set-relation skipping.

Sets meet in an index whose lists are keyed by whole position blocks: a set's shingles, in hash order, are cut into blocks
at fixed positions of that order, and a list holds the sets that agree in all shingles of one block. Linked sets differ in fewer shingles
than they have filled blocks, hence agree in some of these; everything else is skipped unseen. A set leaves as many of its longest
lists as it has blocks to spare, so that passages which many texts share connect nothing. What meets
is joined exactly: lists ordered by position and size, of which whole stretches are skipped, and answers
derived from those of a highly similar set.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.components import components
from tabwright.llm.shingles import mixed, shingle_sets
from tabwright.llm.tables import portions, text_bytes
from tabwright.storage import written

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 90
SHINGLE_WORDS = 3
#: Shingles of the sets that are joined in one task.
TASK_SHINGLES = 2_000_000
#: Filled blocks over the fewest with which linked sets meet.
SPARE = 1.1
#: Sets of which a task remembers that it has seen them.
REMEMBERED = 1_000_000

_TAG = np.uint64(0xD6E8FEB86659FD93)


class SizeClasses:
    """Sizes in classes such that sets which may link lie in the same class or in neighbouring ones."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent = percent
        self.low = [1]
        self._blocks: dict[int, int] = {}

    def reach(self, size: int) -> int:
        """The largest set that may link with one of ``size``."""
        return 100 * size // self.percent

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.high(len(self.low) - 1) + 1)
        return bisect_left(self.low, size + 1) - 1

    def high(self, k: int) -> int:
        # Two reaches to a class: about half of its sets may link with the next one.
        return self.reach(self.reach(self.low[k]))

    def differ(self, k: int) -> int:
        """The most shingles in which two linked sets, the larger one of class ``k``, can differ."""
        if k + 1 >= len(self.low):
            self.of(self.high(k) + 1)
        return 2 * self.high(k) * (100 - self.percent) // (100 + self.percent)

    def blocks(self, k: int) -> int:
        """Blocks of class ``k``: so many that the smallest sets in its lists nearly always fill a share of ``SPARE`` more than ``differ(k)``."""
        if k not in self._blocks:
            needed = self.differ(k) + 1
            size, wanted = self.low[k] * self.percent / 100, SPARE * needed
            blocks = math.ceil(wanted)
            while blocks < 2 * needed:
                empty = blocks * math.exp(-size / blocks)
                if blocks - empty - 4 * math.sqrt(empty) >= wanted:
                    break
                blocks += max(1, needed // 100)
            self._blocks[k] = blocks
        return self._blocks[k]


def _block_sums(ordered: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Digest and number of shingles of every block of the hash order."""
    bounds = np.array([-(-(k << 64) // blocks) for k in range(1, blocks)], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(ordered, bounds), [len(ordered)]])
    total = np.zeros(len(ordered) + 1, np.uint64)
    np.cumsum(mixed(ordered ^ _TAG), out=total[1:])
    counts = np.diff(cuts)
    return total[cuts[1:]] - total[cuts[:-1]], counts


def block_keys(ordered: np.ndarray, classes: SizeClasses) -> list[tuple[int, np.ndarray]]:
    """Keys of the index lists that a set stands in, for its own class and the next one, each with the number of lists it may leave.

    A block without shingles is no evidence and has no key. Linked sets differ in at most ``differ`` shingles, so one that fills more
    blocks shares all but that many of its lists with every set that it links with. Of the shared lists of two such sets, the shortest is
    left by neither, as each leaves fewer of its longest lists than it shares. A set that does not fill enough, by chance, leaves none; it
    also stands in the lists of a second cut, by another order of the shingles, and, should that fail too, in those of its
    single shingles: two such sets meet there.
    """
    own, size = classes.of(len(ordered)), len(ordered)
    found = []
    for k in (own, own + 1):
        most = classes.differ(k)
        if not most or k > own and classes.reach(size) < classes.low[k]:
            # Only equal sets link, or none of the next class.
            found.append((0, np.empty(0, np.uint64)))
            continue
        blocks = classes.blocks(k)
        place = np.arange(blocks, dtype=np.uint64)
        keys, spare = [], 0
        for cut in range(3):
            tag = np.uint64((k << 2 | cut) << 32)
            if cut == 2:
                keys.append(mixed(mixed(ordered ^ _TAG) + mixed(tag)))
                break
            sums, counts = _block_sums(np.sort(mixed(ordered + _TAG)) if cut else ordered, blocks)
            filled = counts > 0
            keys.append(mixed(mixed(sums + mixed(place + tag)) + counts.astype(np.uint64))[filled])
            if int(filled.sum()) > most:
                spare = 0 if cut else int(filled.sum()) - most - 1
                break
        found.append((spare, np.concatenate(keys)))
    return found


def _digest(ordered: np.ndarray, doc_id: int | None) -> bytes:
    """Equal sets have equal digests; an empty set equals no other."""
    return hashlib.blake2b(ordered.tobytes(), digest_size=16).digest() if len(ordered) else f"{doc_id}".encode()


def _arrays(lists: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(lists).view(np.int64) if lists else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32)), pa.array(flat))


def _indexed(words: int, percent: int):
    """Per row: size and digest of its set; with the first row of a set in a task, its number, and its keys for both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, number, seen = SizeClasses(percent), TaskContext.get().partitionId() << 40, set()
        nothing = [(0, np.empty(0, np.uint64))] * 2
        for batch in portions(batches, "text"):
            sets = shingle_sets(text_bytes(batch.column("text")), words)
            digests = [_digest(s, i) for s, i in zip(sets, batch.column("doc_id").to_pylist())]
            nodes, keys = [], []
            for ordered, digest in zip(sets, digests):
                if digest in seen:
                    nodes.append(None)
                    keys.append(nothing)
                    continue
                if len(seen) >= REMEMBERED:  # what is forgotten only gets another number
                    seen.clear()
                seen.add(digest)
                nodes.append(number)
                number += 1
                keys.append(block_keys(ordered, classes) if len(ordered) else nothing)
            spare = pa.array([[own[0], following[0]] for own, following in keys], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()),
                 spare, *(_arrays([both[j][1] for both in keys]) for j in (0, 1))],
                ["doc_id", "row", "n_shingles", "digest", "node", "spare", "keys0", "keys1"])

    return run


def _shingled(words: int):
    """The set of every row, beside the columns that it carries."""
    carried = ["cluster", "weight", "node", "wanted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            sets = shingle_sets(text_bytes(batch.column("text")), words)
            digests = pa.array([_digest(s, None) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), digests, _arrays(sets)], [*carried, "digest", "shingles"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and place, those whose list holds others too; the first and last list of a task may, in other tasks."""
    held: tuple[int, int] | None = None  # the last row read
    alone, first = False, True  # whether that row is still unwritten; whether it lies in the first list
    for batch in batches:
        keys, places = np.asarray(batch.column("key")), np.asarray(batch.column("place"))
        if not len(keys):
            continue
        same = np.append(held is not None and keys[0] == held[0], keys[1:] == keys[:-1])
        if alone and (same[0] or first):
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["key", "place"])
        first = first and (held is None or bool(same[0]))
        wanted = same.copy()
        wanted[:-1] |= same[1:]
        if first:
            ends = np.flatnonzero(~same[1:])
            wanted[:ends[0] + 1 if len(ends) else len(keys)] = True
            first = not len(ends)
        yield batch.filter(pa.array(wanted))
        held, alone = (int(keys[-1]), int(places[-1])), not wanted[-1]
    if alone:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["key", "place"])


def linked(sizes: tuple[int, int], shared: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (sizes[0] + sizes[1] - shared)


def join_sets(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (pairs of places in ``sets``) that connect whatever the links between all of them connect.

    Shingles are ordered from the rarest; sets are taken by size. The index keeps, per shingle of a prefix and per position in it, the sets
    in order of size: of such a list, everything too small to reach the needed overlap from that position is skipped. Sets
    of one component derive their answers from its first member, the pivot: distances are a metric, so the distance to the pivot decides
    most of the others without looking at them, and a set once linked skips the rest of that component.
    """
    if not sets:
        return []
    flat = np.concatenate(sets)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ends = np.cumsum([len(s) for s in sets])
    ranked = [np.sort(r) for r in np.split(rank[inverse], ends[:-1])]
    root = list(range(len(sets)))
    pivot_distance = [0.0] * len(sets)
    limit = 1 - percent / 100

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def shared(x: int, y: int) -> int:
        return len(np.intersect1d(ranked[x], ranked[y], assume_unique=True))

    index: dict[int, dict[int, tuple[list[int], list[int]]]] = {}
    members: dict[int, int] = {}
    links: list[tuple[int, int]] = []
    for y in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        own, size = ranked[y], len(sets[y])
        if not size:
            continue
        prefix = own[:size - -(-percent * size // 100) + 1].tolist()
        candidates: dict[int, None] = {}
        for token in prefix:
            for i, (lengths, held) in index.get(token, {}).items():
                # From position i, a set of length n reaches at most n - i shared shingles; it needs percent / (100 + percent) of both sizes.
                least = max(-(-percent * size // 100), -(-(percent * size + (100 + percent) * i) // 100))
                for x in held[bisect_left(lengths, least):]:
                    candidates[x] = None
        known: dict[int, float] = {}  # distance of y to the pivots
        for x in candidates:
            if find(x) == find(y):
                continue
            p = members[x]
            if p not in known:
                o = shared(p, y)
                known[p] = 1 - o / (len(sets[p]) + size - o)
                if linked((len(sets[p]), size), o, percent):
                    links.append((p, y))
                    root[find(y)] = find(p)
                    continue
            if abs(known[p] - pivot_distance[x]) > limit + 1e-9:
                continue
            if p != x and linked((len(sets[x]), size), shared(x, y), percent):
                links.append((x, y))
                root[find(y)] = find(x)
        # The pivot whose distance is known best describes y; without one, y is a pivot itself.
        best = min(known, key=known.get, default=None)
        if best is not None and find(best) == find(y):
            members[y], pivot_distance[y] = best, known[best]
        else:
            members[y], pivot_distance[y] = y, 0.0
        for i, token in enumerate(prefix):
            lengths, held = index.setdefault(token, {}).setdefault(i, ([], []))
            lengths.append(size)
            held.append(y)
    return links


def _joined(percent: int):
    """Every set of one task, hung on to the smallest node of what it is connected with there."""

    def run(table: pa.Table) -> pa.Table:
        seen: dict[int, np.ndarray] = {}
        for node, shingles in zip(table.column("node").to_pylist(), table.column("shingles")):
            seen.setdefault(node, np.asarray(shingles.values).view(np.uint64))
        nodes = list(seen)
        root = list(range(len(nodes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in join_sets(list(seen.values()), percent):
            x, y = find(x), find(y)
            root[y if nodes[x] < nodes[y] else x] = x if nodes[x] < nodes[y] else y
        hung = [(nodes[k], nodes[find(k)]) for k in range(len(nodes)) if find(k) != k]
        return pa.table({"a": pa.array([a for a, _ in hung], pa.int64()), "b": pa.array([b for _, b in hung], pa.int64())})

    return run


def _row_key() -> Column:
    """The same for rows that repeat an id (or its lack) and a text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def jaccard_components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their sets of ``words``-word shingles;
    ``component_id`` is the smallest doc_id that links reach. A document without words (or with a null text) links with nothing. A
    document without an id links like any other but counts in no component id; one that reaches no id has a null one. Rows that repeat an
    id and a text are copies; equal ids with different texts are distinct documents. Other columns are ignored.

    Texts are shingled once; copies of a set in one task have one number from the start, others are joined to the smallest number by their
    digest. Entries of the index are sorted by range, so that a list of any length spreads over tasks; only those of lists with
    several sets go on. Sets that share a list form clusters, and a cluster of more than ``task_shingles`` is joined in pairs of bounded parts.
    """
    return _components(docs, words, percent, task_shingles).drop("row")


def _components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """``jaccard_components`` with the key of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_key().alias("row"))
    indexed = "doc_id long, row long, n_shingles long, digest binary, node long, spare array<int>, keys0 array<long>, keys1 array<long>"
    base = written(rows.mapInArrow(_indexed(words, percent), indexed), "join-index")
    # One row of every set, with an id if there is one, stands for it.
    with_id = F.min(F.when(F.col("doc_id").isNotNull(), F.col("row")))
    nodes = base.groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("least_id"), F.coalesce(with_id, F.min("row")).alias("row"),
                                       F.first("n_shingles").alias("n"))
    nodes = written(nodes, "join-nodes")
    # A set has one place per class; what it may leave is counted per place.
    of_place = [(F.col("node") * 2 + j).alias("place") for j in (0, 1)]
    entries = base.select(of_place[0], F.explode("keys0").alias("key")).union(base.select(of_place[1], F.explode("keys1").alias("key")))
    shared = entries.repartitionByRange("key", "place").sortWithinPartitions("key", "place").select("key", "place").mapInArrow(_shared, "key long, place long")
    shared = written(shared, "join-shared")
    # Written, so that the joins read plain shuffles and a list of very many sets can be split between tasks.
    lengths = written(shared.groupBy("key").agg(F.count(F.lit(1)).alias("length")).filter("length > 1"), "join-lengths")
    spare = base.filter("node IS NOT NULL").select(of_place[0], F.col("spare")[0].alias("spare")).union(base.filter("node IS NOT NULL").select(of_place[1], F.col("spare")[1]))
    longest = Window.partitionBy("place").orderBy(F.col("length").desc(), F.col("key"))
    rated = shared.join(lengths.hint("merge"), "key").withColumn("rank", F.row_number().over(longest))
    entered = rated.join(spare.filter("spare > 0").hint("merge"), "place", "left").filter(F.col("rank") > F.coalesce("spare", F.lit(0)))
    entered = written(entered.select("key", F.expr("place div 2").alias("node")), "join-entered")
    lists = entered.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("key", "first")
    lists = written(lists, "join-lists")
    meeting = entered.join(lists.hint("merge"), "key").filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    # What grows with the documents is never broadcast, here and below, small as it may be for a small table.
    numbers = base.filter("node IS NOT NULL").select("digest", F.col("node").alias("other")).join(nodes.select("digest", "node").hint("merge"), "digest")
    numbers = written(numbers.filter("other <> node").select("other", "node"), "join-numbers")
    for end in ("a", "b"):
        again = numbers.select(F.col("other").alias(end), "node").hint("merge")
        meeting = meeting.join(again, end, "left").withColumn(end, F.coalesce("node", end)).drop("node")
    clusters = written(components(meeting), "join-clusters").withColumnRenamed("root", "cluster")
    wanted = clusters.join(nodes.select("node", "digest", "row", "n").hint("merge"), "node")
    weight = wanted.groupBy("cluster").agg(F.sum("n").alias("weight"))
    wanted = written(wanted.join(weight, "cluster"), "join-wanted")
    # Copies without an id share their key, so they are summed before they are shuffled.
    single = rows.filter("doc_id IS NOT NULL").select("row", "text").union(rows.filter("doc_id IS NULL").select("row", "text").distinct())
    texts = single.join(wanted.select("cluster", "weight", "node", "row", F.col("digest").alias("wanted")).hint("merge"), "row")
    sets = texts.mapInArrow(_shingled(words), "cluster long, weight long, node long, wanted binary, digest binary, shingles array<long>")
    sets = sets.filter("wanted = digest")
    parts = F.when(F.col("weight") > task_shingles, F.ceil(F.col("weight") / (task_shingles // 2))).otherwise(1).cast("int")
    sets = sets.select("cluster", "node", "shingles", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    # A row goes to every pair of parts that holds its own.
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = sets.groupBy("cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    links = pairs.applyInArrow(_joined(percent), "a long, b long")
    classes = components(links).join(nodes.select("node", "least_id").hint("merge"), "node")
    least = written(classes.groupBy("root").agg(F.min("least_id").alias("component_id")), "join-least")
    named = classes.select("node", "root").join(least.hint("merge"), "root").select("node", "component_id", F.lit(True).alias("linked"))
    named = nodes.select("digest", "node", "least_id").join(named.hint("merge"), "node", "left")
    of_set = named.select("digest", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"))
    return base.join(of_set, "digest", "left").select("doc_id", "row", "n_shingles", "component_id")


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the smallest of their component.

    Rows that repeat an id and a text stay or go together; rows without an id stay only where nothing they link with has one.
    """
    stays = _components(docs, **how).filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "row").distinct()
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("own_id"), _row_key().alias("own_row"))
    own = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_row") == F.col("row"))
    return rows.join(stays.hint("merge"), own, "left_semi").select("whole.*")
