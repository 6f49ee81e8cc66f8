"""Mixing sources to target weights by drawing packed blocks of words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.tables import WORD, numbered, word_count
from tabwright.storage import written

#: Words of one block, and blocks (slots) of one output shard.
BLOCK_WORDS = 32
SHARD_BLOCKS = 1 << 16
#: A source is repeated at most so often.
MOST_REPEATS = 3
#: Sources of one mix. Their names and totals are the only thing that the driver and every task hold whole; beyond this a mix is refused.
MOST_SOURCES = 1_000_000
#: Slots that a task makes on average.
TASK_SLOTS = 100_000

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Mix:
    """``sources``: name, size, target, blocks, draws of each source. ``rows``: the documents, packed. ``slots``: the draws."""

    sources: pd.DataFrame
    rows: DataFrame
    slots: DataFrame
    block_words: int


def water_filled(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_REPEATS) -> list[float]:
    """Share the sum of ``sizes`` by weight; what lies above ``most`` times a size is shared among the others, again and again."""
    caps = [most * s for s in sizes]
    open_, result = set(range(len(sizes))), [float(c) for c in caps]
    while open_:
        rest = sum(sizes) - sum(caps[i] for i in range(len(sizes)) if i not in open_)
        unit = rest / sum(weights[i] for i in open_)
        above = {i for i in open_ if unit * weights[i] > caps[i]}
        if not above:
            for i in open_:
                result[i] = unit * weights[i]
            break
        open_ -= above
    return result


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of ``0 .. size - 1``, evaluated at ``index``: a keyed Feistel network that walks on until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = _mixed(np.uint64(key & int(_MASK)) + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & low
        for k in keys:
            left, right = right, left ^ (_mixed(right + k) & low)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= np.uint64(size)]
    return x.astype(np.int64)


def _key(seed: int, source: int, epoch: int) -> int:
    return int(_mixed(np.array([(seed * 1_000_003 + source) * 64 + epoch], dtype=np.uint64))[0])


def _slots(blocks: np.ndarray, draws: np.ndarray, totals: np.ndarray, seed: int):
    """Turn ranges of a source's slots into blocks.

    The multinomial totals miss ``draws`` by their noise: slots beyond a source's ``draws`` go, in order, to the sources that
    came out short.
    """
    surplus, short = np.maximum(totals - draws, 0), np.maximum(draws - totals, 0)
    first_surplus = np.cumsum(surplus) - surplus
    short_ends = np.cumsum(short)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, slot, source, start, n in batch[["shard", "slot", "source", "start", "n"]].itertuples(index=False):
                k = np.arange(start, start + n)
                sources = np.full(n, source)
                over = k >= draws[source]
                if over.any():
                    u = first_surplus[source] + k[over] - draws[source]
                    to = np.searchsorted(short_ends, u, side="right")
                    sources[over], k[over] = to, totals[to] + u - (short_ends[to] - short[to])
                block = np.empty(n, np.int64)
                epoch = k // blocks[sources]
                for s, e in set(zip(sources.tolist(), epoch.tolist())):
                    own = (sources == s) & (epoch == e)
                    block[own] = permuted(k[own] % blocks[s], int(blocks[s]), _key(seed, s, e))
                yield pd.DataFrame({"shard": shard, "slot": slot + np.arange(n), "source": sources, "block": block})

    return run


def plan_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS,
             most: int = MOST_REPEATS, seed: int = 0, with_text: bool = False) -> Mix:
    """Pack all documents into blocks and draw the mix.

    The sources, by code point and null last, weigh ``weights`` in turn and share as many words as there are. The words of a
    source, its documents by doc_id, are packed into blocks of ``block_words`` (documents without words, or a null text,
    fill none). Every output shard draws a multinomial count of slots per source; a source's slots are numbered through all
    shards and mapped to its blocks by a permutation of their indexes, another one for each repetition, so that no block is
    drawn more than ``most`` times. All draws depend on ``seed`` only, so reruns agree. An empty table has an empty mix.
    """
    spark = docs.sparkSession
    name = F.col("source").cast("string")
    base = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("source_name"), word_count(F.col("text")).alias("size"),
                               *([F.col("text")] if with_text else [])), "mix-rows")
    found = base.groupBy("source_name").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).toPandas()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = sorted((None if pd.isna(s) else s for s in found["source_name"]), key=lambda s: (s is None, (s or "").encode()))
    size_of = {None if pd.isna(s) else s: int(n) for s, n in zip(found["source_name"], found["size"])}
    sizes = [size_of[s] for s in names]
    targets = water_filled(sizes, [weights[k % len(weights)] for k in range(len(names))], most)
    blocks = [-(-n // block_words) for n in sizes]
    draws = [min(most * b, round(t * b / n)) if n else 0 for t, b, n in zip(targets, blocks, sizes)]
    sources = pd.DataFrame({"source": range(len(names)), "source_name": pd.Series(names, dtype=object), "source_size": pd.Series(sizes, dtype="int64"),
                            "target": pd.Series(targets, dtype=float), "blocks": pd.Series(blocks, dtype="int64"), "draws": pd.Series(draws, dtype="int64")})
    known = _source_table(spark, sources).withColumnRenamed("source_name", "known_name").select("source", "known_name")
    rows = base.join(F.broadcast(known), F.col("source_name").eqNullSafe(F.col("known_name"))).drop("known_name")
    order = [F.col("doc_id").asc_nulls_last(), F.col("size")]
    rows = numbered(rows, "source", order, "size", "mix-packed")

    total = sum(draws)
    shards = -(-total // shard_blocks)
    share = np.array(draws, float) / max(1, total)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                n = np.random.default_rng([seed, int(shard)]).multinomial(min(shard_blocks, total - int(shard) * shard_blocks), share)
                yield pd.DataFrame({"shard": int(shard), "source": np.flatnonzero(n), "slot": (np.cumsum(n) - n)[n > 0], "n": n[n > 0]})

    drawn = written(spark.range(shards).mapInPandas(draw, "shard long, source int, slot long, n long"), "mix-draws")
    came = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    totals = np.array([came.get(s, 0) for s in range(len(names))], np.int64)
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # A row of starts stands for many slots, so the rows are dealt over tasks in proportion to the slots, whatever their source.
    dealt = written(starts, "mix-starts").repartition(total // TASK_SLOTS + 1, "shard", "source")
    slots = dealt.mapInPandas(_slots(np.maximum(np.array(blocks, np.int64), 1), np.array(draws, np.int64), totals, seed),
                               "shard long, slot long, source int, block long")
    return Mix(sources, rows, slots, block_words)


def _source_table(spark, sources: pd.DataFrame) -> DataFrame:
    rows = [(int(r.source), r.source_name, int(r.source_size), float(r.target)) for r in sources.itertuples()]
    return spark.createDataFrame(rows, "source int, source_name string, source_size long, target double")


def _pieces(mix: Mix) -> DataFrame:
    """One row for every part of a document that lies in one block."""
    size, before, b = F.col("size"), F.col("before"), mix.block_words
    first, last = F.floor(before / b), F.floor((before + size - 1) / b)
    pieces = mix.rows.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * b, before)
    return pieces.withColumns({"start": start - before, "words": F.least((F.col("block") + 1) * b, before + size) - start})


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: ``doc_id, source_name, size, source_size, target, taken``, the words that all drawn blocks take of it."""
    # As many rows as there are drawn blocks: never broadcast, though the planner sees only the small table of draws below it.
    times = mix.slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (_pieces(mix).select("source", "block", "place", "words").join(times.hint("merge"), ["source", "block"])
             .groupBy("source", "place").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    known = _source_table(mix.rows.sparkSession, mix.sources).drop("source_name")
    return (mix.rows.select("doc_id", "source", "source_name", "size", "place").join(taken, ["source", "place"], "left")
            .join(F.broadcast(known), "source")  # at most MOST_SOURCES rows
            .select("doc_id", "source_name", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def mixed_blocks(mix: Mix) -> DataFrame:
    """The mix itself: ``shard, slot, source, block, text, doc_ids``, one row per drawn block (plan it ``with_text``)."""
    word = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.slice(word, F.col("start").cast("int") + 1, F.col("words").cast("int")), " ")
    packed = _pieces(mix).select("source", "block", "place", "doc_id", part.alias("part")).groupBy("source", "block").agg(
        F.array_sort(F.collect_list(F.struct("place", "part", "doc_id"))).alias("parts"))  # at most block_words parts
    return mix.slots.hint("merge").join(packed, ["source", "block"]).select(
        "shard", "slot", "source", "block", F.array_join("parts.part", " ").alias("text"), F.col("parts.doc_id").alias("doc_ids"))


def mixed_documents(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them whole, with all their columns.

    A document of which the mix takes ``t`` times its words appears ``floor(t)`` times, and once more with the probability of the rest, decided by a
    hash of its id. Documents without words are not drawn, an empty table gives an empty one. Rows that repeat an id, a null one
    too, share what the mix takes of it. Columns may have any names.
    """
    taken = taken_words(plan_mix(docs, seed=seed, **how)).groupBy("doc_id").agg(F.sum("taken").alias("taken_"), F.sum("size").alias("size_"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    times = taken.filter("size_ > 0").select(F.col("doc_id").alias("drawn_"), F.floor(F.col("taken_") / F.col("size_") + chance).cast("int").alias("times_"))
    # Rows travel as a struct, so that no column of theirs clashes with the helpers.
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("own"))
    drawn = rows.join(times.filter("times_ > 0").hint("merge"), F.col("own").eqNullSafe(F.col("drawn_")))
    return drawn.select("whole", F.explode(F.sequence(F.lit(1), F.col("times_")))).select("whole.*")
