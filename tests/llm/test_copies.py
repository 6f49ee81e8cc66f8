"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import components, exact_dedup, ngram_join, shingles, suffix_dedup, suffix_sort

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def odd_rows():
    return [(1, "Same Text"), (5, "same text"), (3, "SAME TEXT"), (7, None), (8, ""), (9, "x"), (None, "x"), (None, None), (4, "É same"), (6, "é same"),
            (10, "long " * 40_000), (11, "LONG " * 40_000), (12, "dup"), (12, "dup"), (None, "only"), (None, "ONLY"), (13, "a" * 64 + "b"), (14, "a" * 64 + "c")]


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for body, ids in groups.items():
        known = sorted((i for i in ids if i is not None), reverse=True)
        ordered = known + [None] * (len(ids) - len(known))
        out += [(i, ordered[0], len(ids), k == 0, hashlib.sha256(body.encode()).hexdigest()) for k, i in enumerate(ordered)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [odd_rows(), [], [(i, "one text") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(50)]])
def test_exact_duplicates(spark, rows):
    got = exact_dedup.exact_duplicates(frame(spark, rows).withColumn("digest", F.lit("clash")))
    assert sorted(map(tuple, got.collect()), key=repr) == exact_brute(rows)


def test_exact_copies_split_between_tasks(spark):
    """With two tasks per group at least, runs meet across borders."""
    rows = [(i, "hot") for i in range(3000)] + [(10_000 + i, f"cold {i % 7}") for i in range(100)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_duplicates(frame(spark, rows))
        assert sorted(map(tuple, got.collect()), key=repr) == exact_brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_deduplicated_keeps_columns(spark):
    docs = frame(spark, odd_rows()).withColumns({"row_key": F.lit(1), "head": F.lit("h")})
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    want = Counter(r[0] for r in exact_brute(odd_rows()) if r[3])
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def shingle_brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 3:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + 3]) for k in range(len(words) - 2))


def near_brute(rows, percent=90):
    sets = [shingle_brute(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def near_rows(seed=3, families=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 6))) for _ in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(families):
        words = rng.choices(vocabulary, k=rng.choice([8, 12, 25, 60, 150, 400]))
        if rng.random() < 0.5:
            words += passage
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 % 1009, " ".join(copy)))
    return rows


@pytest.mark.parametrize("limit", [2_000_000, 3000])
def test_near_copies(spark, limit):
    """Also where a cluster is joined in parts."""
    rows = near_rows() + [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, "one two"), (None, rows_text(7)), (2005, rows_text(7)), (2006, "\t \n"), (2007, "w " * 5000)]
    got = ngram_join.jaccard_components(frame(spark, rows).withColumn("keys", F.lit("clash")), task_shingles=limit)
    assert sorted(map(tuple, got.collect()), key=repr) == near_brute(rows)


def rows_text(k):
    return near_rows()[k][1]


def test_near_copies_of_nothing(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).collect() == []
    kept = ngram_join.representatives(frame(spark, [(1, "a b c d"), (2, "A b c d"), (None, None), (3, "")]))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "a b c d"), (None, None), (3, "")], key=repr)


def test_join_in_one_task():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = [rng.integers(0, 3000, rng.integers(5, 120)) for _ in range(4)]
        sets = []
        for _ in range(30):
            s = base[rng.integers(4)].copy()
            s[rng.integers(0, len(s), rng.integers(0, len(s) // 8 + 1))] = rng.integers(0, 3000)
            sets.append(np.unique(s).astype(np.uint64))
        want = {frozenset((a, b)) for a in range(30) for b in range(a) if ngram_join.linked((len(sets[a]), len(sets[b])), len(np.intersect1d(sets[a], sets[b])))}
        got = {frozenset(x) for x in ngram_join.join_sets(sets)}
        assert got <= want
        assert reach(30, got) == reach(30, want)


def reach(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in (sorted(x) for x in links):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_list(percent, monkeypatch):
    """The pigeonhole argument; with far too few blocks, most sets need the second cut, and some their single shingles."""
    rng = np.random.default_rng(1)
    met = Counter()
    for blocks in (None, 1.0, 0.4):
        classes = ngram_join.SizeClasses(percent)
        if blocks:
            monkeypatch.setattr(classes, "blocks", lambda k: max(2, int(blocks * classes.differ(k)) + 1))
        for _ in range(1500):
            n = int(rng.integers(9, 80))
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = a.copy()
            swaps = int(rng.integers(0, n // 8 + 1))
            b[:swaps] = rng.integers(0, 2**64, swaps, dtype=np.uint64)
            b = b[:n - int(rng.integers(0, 3))]
            a, b = np.unique(a), np.unique(b)
            if ngram_join.linked((len(a), len(b)), len(np.intersect1d(a, b)), percent) and len(np.union1d(a, b)) > len(np.intersect1d(a, b)):
                met[blocks] += 1
                both = [[(spare, set(keys.tolist())) for spare, keys in ngram_join.block_keys(x, classes)] for x in (a, b)]
                # Each leaves as many of its lists as it may, in the same random order of lists.
                left = [set() for _ in both]
                for x, places in enumerate(both):
                    for spare, keys in places:
                        left[x] |= set(sorted(keys, key=lambda key: hash((key, 3)))[spare:])
                assert left[0] & left[1]
    assert min(met.values()) > 200


@pytest.mark.parametrize("percent", [80, 90])
def test_keys_grow_with_the_set(percent):
    classes, rng = ngram_join.SizeClasses(percent), np.random.default_rng(2)
    for size in (300, 1000, 3000, 10_000, 50_000):
        sets = [np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(5)]
        assert max(sum(len(keys) for _, keys in ngram_join.block_keys(s, classes)) for s in sets) < size


def test_lists_that_go_on_in_other_tasks(spark):
    """One hot list among others, cut into many tasks."""
    entries = [(7, k) for k in range(400)] + [(k, k) for k in range(400, 600)] + [(8, 5), (8, 600)]
    frame = spark.createDataFrame(entries, "key long, place long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for tasks in (1, 3, 20):
            rows = frame.repartitionByRange(tasks, "key", "place").sortWithinPartitions("key", "place").mapInArrow(ngram_join._shared, "key long, place long")
            got = [tuple(r) for r in rows.collect()]
            lists = Counter(key for key, _ in got)
            assert len(set(got)) == len(got) and {e for e in got if lists[e[0]] > 1} == {e for e in entries if e[0] < 400}
            assert sum(n == 1 for n in lists.values()) <= 2 * tasks
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("cuts", [[], [1], [3], [1, 2, 3, 4, 5, 6, 7], [5]])
def test_shared_rows_across_batches(cuts):
    rows = [(1, 1), (2, 1), (2, 2), (3, 5), (4, 1), (4, 2), (4, 3), (9, 9)]
    batches = [ngram_join.pa.RecordBatch.from_pylist([{"key": k, "place": p} for k, p in rows[a:b]], ngram_join.pa.schema([("key", "int64"), ("place", "int64")]))
               for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    got = [(r["key"], r["place"]) for b in ngram_join._shared(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == [r for r in rows if r[0] != 3]


def test_shingles_of_long_texts():
    text = ("word%d " * 9 % tuple(range(9)) + "été\n").encode() * 60_000
    pieces = shingles.shingle_sets([text])[0]
    shingles.PIECE_BYTES, old = 1 << 22, shingles.PIECE_BYTES
    try:
        assert np.array_equal(pieces, shingles.shingle_sets([text])[0]) and len(pieces) == 10
    finally:
        shingles.PIECE_BYTES = old


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500 + k, 501 + k) for k in range(60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = [e for e in edges if None not in e and e[0] != e[1]]
    want = reach(600, ends)
    assert got == {x: want[x] for e in ends for x in e}


def test_deep_shallow_sort():
    rng = random.Random(1)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.5:
            strings = [b"c" * 40 + s for s in strings]
        order, shared = suffix_sort.deep_shallow_sort(strings)
        placed = [strings[k] for k in order]
        assert sorted(order) == list(range(len(strings))) and placed == sorted(strings)
        assert shared == [0] + [suffix_sort.common_prefix(a, b) for a, b in zip(placed, placed[1:])]
    assert suffix_sort.deep_shallow_sort([]) == ([], [])


def passages_brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        covered = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if times[t[k:k + length]] > 1:
                covered[k:k + length] = True
        runs = int((np.diff(np.concatenate([[False], covered]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~covered[:-1]])
        out.append((i, len(t), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passage_rows():
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choices("abcdé ", k=n))
    common = letters(400)
    rows = [(k, letters(rng.randrange(0, 300)) + common[rng.randrange(150):rng.randrange(200, 400)] + letters(rng.randrange(300))) for k in range(25)]
    rows += [(30, common), (31, common), (32, common * 2), (33, "a" * 1000), (34, "ab" * 300), (35, None), (36, ""), (37, "short"), (38, "short")]
    return rows + [(None, letters(300)), (None, common[:250]), (0, "another " + common[100:350]), (39, letters(5000) + common[50:260]), (31, common)]


@pytest.mark.parametrize("group_rows", [20_000, 2])
def test_repeated_passages(spark, group_rows):
    """Both ways of comparing the ends of passages."""
    docs = frame(spark, passage_rows()).withColumn("key", F.lit("clash"))
    got = suffix_dedup.repeated_passages(docs, group_rows=group_rows).drop("removed")
    assert sorted(map(tuple, got.collect()), key=repr) == passages_brute(passage_rows())


def test_repeated_passages_of_nothing(spark):
    assert suffix_dedup.repeated_passages(frame(spark, [])).collect() == []
    row = suffix_dedup.repeated_passages(frame(spark, [(1, "x" * 199)])).first()
    assert (row["n_removed"], row["removed"]) == (0, [])


def test_long_texts_are_scanned_in_stretches(spark, monkeypatch):
    rows = passage_rows()
    monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", 97)
    parts = list(suffix_dedup._entries(200)(iter([frame_batch(rows)])))
    windows = sum(int(np.sum(p.column("windows").to_numpy())) for p in parts)
    assert windows == sum(max(0, len((t or "").encode()) - 199) for _, t in rows)


def frame_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"node": [i or 0 for i, _ in rows], "text": [t for _, t in rows]})
