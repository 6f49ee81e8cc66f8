"""Runs of words that repeat with a period, found by seeds on diagonals.

A run of smallest period q and at least ``max(LEAST_WORDS, LEAST_PERIODS * q)`` words agrees with itself, q words on, in at least
16 and more than q words. Grams of 16, 32, 64, ... words are indexed by exact ranks, each rank from two of half the size. A gram not
shorter than q recurs inside the run after q words and not before, so only neighbouring occurrences of a gram are
enumerated: those of the 16-grams up to 16 words apart, those of the k-grams more than k / 2 and up to k words apart. A
seed is extended both ways along its diagonal; per lag, the end of the furthest extension suppresses seeds that it covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.shingles import mixed, word_hashes
from tabwright.llm.tables import portions, text_bytes

#: A run has at least so many words and so many times its period. Three periods make the overlap longer than the period.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the smallest grams: LEAST_WORDS less the longest period for which that, not LEAST_PERIODS, is the limit.
LEAST_GRAM = 16

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that occur more than once, in order of key and place, and their ranks."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    follows = np.zeros(len(keys) + 1, bool)
    follows[1:-1] = ordered[1:] == ordered[:-1]
    several = follows[1:] | follows[:-1]
    return order[several], np.cumsum(~follows[:-1])[several]


def seeds(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per size of grams, ``start`` and ``lag`` of neighbouring occurrences; ``words`` are numbers, equal for equal words."""
    n, size = len(words), 1
    at, rank = _repeated(words)
    while len(at):
        if size >= LEAST_GRAM:
            near = rank[1:] == rank[:-1]
            start, lag = at[:-1][near], np.diff(at)[near]
            wanted = (lag <= size) & (lag > (size // 2 if size > LEAST_GRAM else 0))
            yield start[wanted], lag[wanted]
        ranks = np.zeros(n + size, np.int64)
        ranks[at] = rank
        # Both halves of a repeated gram are repeated themselves.
        at = np.sort(at)
        at = at[ranks[at + size] > 0]
        again, rank = _repeated(ranks[at] * np.int64(n + 1) + ranks[at + size])
        at, size = at[again], 2 * size


def extended(words: np.ndarray, start: int, lag: int) -> tuple[int, int]:
    """The stretch around ``start`` in which each word equals the one ``lag`` words on: first place, and first beyond."""
    begin, end, last = start, start, len(words) - lag
    step = 64
    while end < last:
        differ = np.flatnonzero(words[end:min(end + step, last)] != words[end + lag:min(end + step, last) + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = min(end + step, last), 2 * step
    while begin and words[begin - 1] == words[begin - 1 + lag]:
        begin -= 1
    return begin, end


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every maximal run, by start and period."""
    found = []
    covered: dict[int, int] = {}
    for starts, lags in seeds(words):
        order = np.lexsort((starts, lags))
        starts, lags = starts[order], lags[order]
        # A seed that follows another one on its diagonal lies in the same stretch.
        first = np.append(True, (np.diff(starts) != 1) | (np.diff(lags) != 0)) if len(starts) else np.empty(0, bool)
        for start, lag in zip(starts[first].tolist(), lags[first].tolist()):
            if start < covered.get(lag, 0):
                continue
            begin, covered[lag] = extended(words, start, lag)
            length = covered[lag] - begin + lag
            if length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                found.append((begin, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _may_repeat(texts: list[bytes]) -> np.ndarray:
    """Whether a text has two 16-grams of equal hash; texts without have no run."""
    found = np.zeros(len(texts), bool)
    words, starts = word_hashes(b" ".join(texts))
    cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    document = np.repeat(np.arange(len(texts)), np.diff(cuts))
    grams, size = words, 1
    while size < LEAST_GRAM and len(grams) > size:
        grams, size = mixed(grams[:-size] * np.uint64(3) + grams[size:]), 2 * size
    if size < LEAST_GRAM or not len(grams):
        return found
    whole = document[:len(grams)] == document[LEAST_GRAM - 1:]
    document = document[:len(grams)][whole]
    at, _ = _repeated(mixed(grams[whole] ^ (document.astype(np.uint64) << np.uint64(32))))
    found[document[at]] = True
    return found


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that lie in a run after its first period."""
    if found:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def _runs_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in portions(batches, "text"):
        texts = text_bytes(batch.column("text"))
        all_runs, rest = [], []
        for text, may in zip(texts, _may_repeat(texts)):
            words = text.split()
            found = []
            if may:
                numbers: dict[bytes, int] = {}
                found = runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
            all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            rest.append(_collapsed(words, found))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(all_runs, kind), pa.array(rest, pa.binary()).cast(pa.string())],
                                         ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, runs, collapsed``.

    ``runs`` holds start (number of the first word), length and period, in words, of every maximal run, by start and period; runs of
    different periods may overlap. ``collapsed`` is the text with single spaces, without the words that a run holds after its
    first period. Texts are whole and compared byte by byte; words are runs of anything but the six ASCII white-space
    characters. A null, empty or blank text has no run and an empty rest. Rows are independent: a null or repeated doc_id
    and repeated rows change nothing. Other columns are ignored, whatever their names. An empty table gives an empty one.

    Nothing is shuffled; a task holds a portion of a few MB, or a single longer text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_runs_of_batches, f"doc_id long, runs {RUNS}, collapsed string")


def strongest(found: Column) -> Column:
    """Of an array of runs, by start and period, the one with the greatest exact length / period; the first of equal ones; null if empty."""
    return F.reduce(found, F.get(found, F.lit(0)), lambda best, run: F.when(
        run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best))


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a repeated ending in about every tenth text.

    With n words, ``h = crc32(doc_id)`` in decimal and ``g = h div 10``: where h is divisible by 10, each word i >= a becomes word
    ``a + (i - a) % p``, with ``a = g % n`` and ``p = 1 + (n - a) div (3 + g % 8)``, and single spaces join the words. A text
    without words, or without a doc_id, stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    ending = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)")
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), ending), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))
