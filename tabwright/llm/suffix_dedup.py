"""Removal of repeated passages by sparse suffix arrays, sorted deep-shallow.

Every window of ``length`` bytes is represented by its anchor, the position in it whose 32 bytes hash lowest. Equal windows
have equal anchors, so only suffixes that begin at anchors need sorting: about one position in 85. Anchors whose 32 bytes occur once
cannot repeat. Where the whole stretch around an anchor (all windows that it stands for) occurs again, all of it is
repeated; the remaining stretches, at the ends of passages, are sorted as suffixes, and common prefixes and
contexts tell which of their windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.shingles import BYTE_VALUES, mixed, power_tables
from tabwright.llm.suffix_sort import deep_shallow_sort
from tabwright.llm.tables import portions, text_bytes
from tabwright.storage import written

LENGTH = 200
SEED_BYTES = 32
#: Stretches of one anchor that are sorted in one task; those of more frequent anchors compare window by window.
GROUP_ROWS = 20_000
#: Texts are scanned in stretches of about so many bytes.
SCAN_BYTES = 1 << 20

_LOW = np.uint64((1 << 24) - 1)


def _anchors(flat: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other in ``flat``: ``text, start, windows, offset, key, span`` of every anchor.

    The windows that start at ``start .. start + windows - 1`` have their anchor at ``start + offset``. ``key`` hashes the bytes at the anchor,
    ``span`` the whole stretch and where the anchor lies in it.
    """
    n, reach = len(flat), length - SEED_BYTES + 1
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty, empty
    up, down = power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[flat] * up[:n], out=total[1:])
    seeds = mixed((total[SEED_BYTES:] - total[:-SEED_BYTES]) * down[:n - SEED_BYTES + 1])
    # The position in the low bits makes the least value tell where it lies; the first of equals wins.
    least = (seeds & ~_LOW) | np.arange(len(seeds), dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = reach - width
    least = np.minimum(least[:len(least) - rest], least[rest:])
    starts = np.concatenate([[0], ends[:-1]])
    windows = np.maximum(ends - starts - length + 1, 0)
    text_of = np.repeat(np.arange(len(ends)), windows)
    if not len(text_of):
        return empty, empty, empty, empty, empty, empty
    at = np.arange(len(text_of)) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    where = (least[at] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (text_of[1:] != text_of[:-1])]))
    count = np.diff(np.concatenate([first, [len(where)]]))
    start, anchor, text = at[first], where[first], text_of[first]
    stop = start + count + length - 1
    span = mixed((total[stop] - total[start]) * down[start] ^ mixed((count * 1024 + anchor - start).astype(np.uint64)))
    return text, start - starts[text], count, anchor - start, seeds[anchor].view(np.int64), span.view(np.int64)


def text_tag(data: bytes) -> int:
    """Tells texts of one id apart."""
    return int.from_bytes(hashlib.sha256(data).digest()[:4], "little", signed=True)


_ENTRIES = "key long, span long, node long, tag int, start int, windows int, offset int"


def _entries(length: int):
    names = [c.split()[0] for c in _ENTRIES.split(", ")]

    def rows(ids: list, texts: list[bytes], begins: list[int]) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(texts), np.uint8)
        text, start, count, offset, key, span = _anchors(flat, np.cumsum([len(t) for t in texts]), length)
        nodes, tags = np.array([i[0] for i in ids], np.int64), np.array([i[1] for i in ids], np.int32)
        start = start + np.array(begins, np.int64)[text]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(span), pa.array(nodes[text]), pa.array(tags[text]), pa.array(start.astype(np.int32)),
                                           pa.array(count.astype(np.int32)), pa.array(offset.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 1 << 14, SCAN_BYTES):
            ids, texts, begins, held = [], [], [], 0
            for node, data in zip(batch.column("node").to_pylist(), text_bytes(batch.column("text"))):
                if len(data) < length:
                    continue
                tag = text_tag(data)
                # A long text goes in stretches that overlap by one byte less than a window.
                for at in range(0, max(1, len(data) - length + 1), 4 * SCAN_BYTES):
                    ids.append((node, tag))
                    texts.append(data[at:at + 4 * SCAN_BYTES + length - 1])
                    begins.append(at)
                    held += len(texts[-1])
                    if held > 2 * SCAN_BYTES:
                        yield rows(ids, texts, begins)
                        ids, texts, begins, held = [], [], [], 0
            if texts:
                yield rows(ids, texts, begins)

    return run


def repeated_windows(before: list[bytes], after: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For suffixes ``after`` of one anchor and what precedes them: the stretches ``first .. last`` of window starts (bytes before the anchor,
    ``first >= last``) that occur at another one too.

    In the sorted order, the suffixes that share ``r`` bytes form a run. Within a run, two that share ``l`` bytes before the anchor share the
    windows that start ``length - r .. l`` bytes before it; the best partner of each is a neighbour in the order of the
    preceding bytes, read backwards.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in after]
    order, shared = deep_shallow_sort([a[:length] for a in after])
    backward = [b[::-1] for b in before]
    # Runs as nodes of the tree of common prefixes: a stack of [shared bytes, first place].
    runs: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []
    for k in range(1, len(order) + 1):
        r = shared[k] if k < len(order) else -1
        first = k - 1
        while stack and stack[-1][0] > r:
            depth, first = stack.pop()
            runs.append((depth, first, k))
        if r >= 0 and (not stack or stack[-1][0] < r):
            stack.append([r, first])
    for r, first, stop in runs:
        inside = order[first:stop]
        if r + max(len(before[x]) for x in inside) < length:
            continue
        back, alike = deep_shallow_sort([backward[x] for x in inside])
        for k, b in enumerate(back):
            left = max(alike[k] if k else 0, alike[k + 1] if k + 1 < len(back) else 0)
            if left + r >= length:
                found[inside[b]].append((left, length - r))
    return found


_INTERVALS = "node long, tag int, start int, stop int"


def _sorted_groups(length: int):
    """Intervals of repeated windows among the stretches of one anchor's bytes."""

    def run(table: pa.Table) -> pa.Table:
        nodes, tags = table.column("node").to_pylist(), table.column("tag").to_pylist()
        starts, windows, offsets = (table.column(c).to_pylist() for c in ("start", "windows", "offset"))
        stretches = table.column("stretch").to_pylist()
        keep = [k for k, s in enumerate(stretches) if s is not None]
        found = repeated_windows([stretches[k][:offsets[k]] for k in keep], [stretches[k][offsets[k]:] for k in keep], length)
        rows = []
        for k, parts in zip(keep, found):
            for left, right in parts:
                # Only windows that this anchor stands for.
                first, last = max(offsets[k] - left, 0), min(offsets[k] - right, windows[k] - 1)
                if first <= last:
                    rows.append((nodes[k], tags[k], starts[k] + first, starts[k] + last + length))
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("node", "tag", "start", "stop"), columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))})

    return run


def _windows(length: int):
    """Digest of every window of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "stretch", 512):
            rows = [(hashlib.blake2b(s[k:k + length], digest_size=16).digest(), node, tag, start + k)
                    for node, tag, start, n, s in zip(*(batch.column(c).to_pylist() for c in ("node", "tag", "start", "windows", "stretch"))) for k in range(n)]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.int32()))], ["window", "node", "tag", "start"])

    return run


def _stretches(length: int):
    """The bytes of the wanted stretches of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 256):
            out: list[tuple] = []
            for data, node, tag, wanted in zip(text_bytes(batch.column("text")), batch.column("node").to_pylist(), batch.column("tag").to_pylist(), batch.column("wanted").to_pylist()):
                if text_tag(data) == tag:
                    out += [(w["key"], w["hot"], node, tag, w["start"], w["windows"], w["offset"], data[w["start"]:w["start"] + w["windows"] + length - 1]) for w in wanted]
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            columns = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "hot", "node", "tag", "start", "windows", "offset", "stretch"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the union of a text's intervals."""
    for batch in portions(batches, "text", 256):
        out: list[tuple] = []
        for data, node, tag, spans in zip(text_bytes(batch.column("text")), batch.column("node").to_pylist(), batch.column("tag").to_pylist(), batch.column("spans").to_pylist()):
            if text_tag(data) != tag:
                continue
            merged: list[list[int]] = []
            for start, stop in sorted((s["start"], s["stop"]) for s in spans):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            kept, at = [], 0
            for start, stop in merged:
                kept.append(data[at:start])
                at = stop
            kept = b"".join([*kept, data[at:]])
            out.append((node, tag, len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in merged]))
        columns = list(zip(*out)) or [[]] * 6
        removed = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), removed)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["node", "tag", "n_removed", "n_spans", "kept_sha256", "removed"])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        texts = text_bytes(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"), pa.array([text_tag(t) for t in texts], pa.int32()),
             pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
            ["doc_id", "node", "tag", "n_bytes", "sha256"])


def repeated_passages(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` (byte intervals, end exclusive).

    A byte is removed when some string of ``length`` bytes that covers it also starts anywhere else, in the same text or another.
    Matches never cross texts; overlaps count; all is judged on the input. Null texts are empty, and texts shorter than
    ``length`` lose nothing. Copies, repeated rows included, remove each other. Null ids are allowed. Other columns are ignored.

    Anchors are counted before anything is joined, so a passage in any number of texts is a few sums. An anchor with more than
    ``group_rows`` different stretches compares digests of its single windows, which are summed likewise.
    """
    if length < SEED_BYTES:
        raise ValueError(f"a window has at least {SEED_BYTES} bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Texts go by their id, those without one by a hash; a tag tells texts of one id apart.
    rows = rows.withColumn("node", F.coalesce("doc_id", F.xxhash64("text")))
    base = written(rows.mapInArrow(_described, "doc_id long, node long, tag int, n_bytes long, sha256 string"), "passage-texts")
    entries = rows.mapInArrow(_entries(length), _ENTRIES)
    keys = entries.groupBy("key").agg(F.min("span").alias("low"), F.max("span").alias("high"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    # Written, so that the join reads plain shuffles and an anchor of very many texts can be split between tasks.
    keys = written(keys.select("key", (F.col("low") == F.col("high")).alias("alike")), "passage-keys")
    met = written(entries.join(keys.hint("merge"), "key"), "passage-anchors")
    mixed_ = met.filter("NOT alike")
    stretch = F.struct("node", "tag", "start", "windows", "offset")
    distinct = written(mixed_.groupBy("key", "span").agg(F.count(F.lit(1)).alias("times"), F.min(stretch).alias("one")), "passage-stretches")
    whole = lambda df: df.select("node", "tag", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("stop"))
    repeated = whole(met.filter("alike")).union(whole(mixed_.join(distinct.filter("times > 1").select("key", "span"), ["key", "span"])))
    # Stretches that occur once, and one of every kind that occurs more often, meet byte by byte.
    kinds = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("fewest")).filter("fewest = 1")
    wanted = distinct.join(kinds, "key").select("one.node", "one.tag", F.struct("key", (F.col("kinds") > group_rows).alias("hot"), "one.start", "one.windows", "one.offset").alias("w"))
    wanted = wanted.groupBy("node", "tag").agg(F.collect_list("w").alias("wanted"))
    long_texts = rows.filter(F.octet_length("text") >= length).select("node", "text")
    pieces = long_texts.join(wanted.hint("merge"), "node").mapInArrow(_stretches(length), "key long, hot boolean, node long, tag int, start int, windows int, offset int, stretch binary")
    pieces = written(pieces, "passage-pieces")
    ends = pieces.filter("NOT hot").groupBy("key").applyInArrow(_sorted_groups(length), _INTERVALS)
    single = pieces.filter("hot").select("node", "tag", "start", "windows", "stretch").mapInArrow(_windows(length), "window binary, node long, tag int, start int")
    several = single.groupBy("window").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("window")
    hot = single.join(several, "window").select("node", "tag", "start", (F.col("start") + length).alias("stop"))
    spans = repeated.union(ends).union(hot).groupBy("node", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    cut = long_texts.join(spans.hint("merge"), "node").mapInArrow(_cut, "node long, tag int, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,stop:int>>")
    cut = cut.dropDuplicates(["node", "tag"])
    nothing = F.array().cast("array<struct<start:int,stop:int>>")
    return base.join(cut, ["node", "tag"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), F.coalesce("removed", nothing).alias("removed"))
