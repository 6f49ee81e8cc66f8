"""Mixing, resharding, top-k and archives."""

import io
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import mixing, resharding, topk, warc
from tabwright.llm.queries import NEW_SHARDS, OLD_SHARDS, QUERIES
from tabwright.storage import scratch_path


def texts(n, seed=0):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "tiny"]
    return [(k, " ".join(f"w{k}_{i}" for i in range(rng.randrange(0, 300))), rng.choices(sources, [9, 5, 3, 2, 0.2])[0]) for k in range(n)]


def docs_of(spark, rows, parts=6):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)


def test_water_filling():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randrange(1, 8)
        sizes, weights = [rng.randrange(0, 100) for _ in range(n)], [rng.choice([1, 2, 3]) for _ in range(n)]
        got = mixing.water_filled(sizes, weights)
        assert sum(got) == pytest.approx(sum(sizes)) and all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes))
        free = [g / w for g, s, w in zip(got, sizes, weights) if g < 3 * s - 1e-9]
        assert not free or max(free) == pytest.approx(min(free))
        assert all(3 * s / w <= min(free, default=1e18) + 1e-9 for g, s, w in zip(got, sizes, weights) if g >= 3 * s - 1e-9)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(size):
    orders = [tuple(mixing.permuted(np.arange(size), size, key)) for key in (0, 5)]
    assert all(sorted(o) == list(range(size)) for o in orders)
    assert size < 7 or orders[0] != orders[1]


def test_mix(spark):
    rows = texts(400)
    rows += [(1000, None, "a"), (1001, " \n", "a"), (None, "null id", "b"), (1002, "x " * 20_000, "b"), (3, "repeated id", "b"), (3, "repeated id", "b")]
    mix = mixing.plan_mix(docs_of(spark, rows), block_words=16, shard_blocks=500, with_text=True)
    got = mixing.taken_words(mix).toPandas()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = mixing.water_filled([sizes[s] for s in names], [1, 2, 3, 1, 2])
    for name, target in zip(names, want):
        own = got[got["source_name"].isna()] if name is None else got[got["source_name"] == name]
        assert own["target"].iloc[0] == pytest.approx(target) and own["source_size"].iloc[0] == sizes[name] == own["size"].sum()
        assert abs(own["taken"].sum() - target) <= max(48, 0.02 * target)
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.taken_words(mixing.plan_mix(docs_of(spark, rows, 3), block_words=16, shard_blocks=500)).toPandas()
    key = ["doc_id", "source_name", "size", "taken"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, got[key].values.tolist()))
    # The texts of the blocks hold what the documents are said to give.
    blocks = mixing.mixed_blocks(mix).toPandas()
    assert sum(len(t.split()) for t in blocks["text"]) == got["taken"].sum()
    assert all(len(t.split()) <= 16 for t in blocks["text"])
    assert Counter(blocks["shard"]) == {k: 500 for k in range(len(blocks) // 500)} | ({len(blocks) // 500: len(blocks) % 500} if len(blocks) % 500 else {})
    slots = blocks.groupby("shard")["slot"].agg(list)
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_mix_of_little(spark):
    assert mixing.taken_words(mixing.plan_mix(docs_of(spark, []))).collect() == []
    row = mixing.taken_words(mixing.plan_mix(docs_of(spark, [(1, None, None)]))).first()
    assert (row["size"], row["source_size"], row["target"], row["taken"]) == (0, 0, 0.0, 0)
    drawn = mixing.mixed_documents(docs_of(spark, [(k, "w " * 50, "a" if k < 20 else "b") for k in range(40)]).withColumn("size", F.lit("clash")))
    assert drawn.columns == ["doc_id", "text", "source", "size"]
    assert max(Counter(r["doc_id"] for r in drawn.collect()).values()) <= 3


def test_flow_moves_least():
    rng = random.Random(3)
    for _ in range(60):
        olds, news = rng.randrange(1, 4), rng.randrange(1, 4)
        held = [rng.randrange(0, 4) for _ in range(olds)]
        room = [0] * news
        for _ in range(sum(held) + rng.randrange(3)):
            room[rng.randrange(news)] += 1
        price = [[rng.randrange(3) for _ in range(news)] for _ in range(olds)]
        flow = resharding.min_cost_flow(held, room, lambda i, j: price[i][j])
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(olds)] == held
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= room[k] for k in range(news))
        units = [i for i, n in enumerate(held) for _ in range(n)]
        best = min((sum(price[i][j] for i, j in zip(units, x)) for x in itertools.product(range(news), repeat=len(units))
                    if all(x.count(k) <= room[k] for k in range(news))), default=0) if len(units) < 9 else None
        assert best is None or sum(price[i][j] * v for (i, j), v in flow.items()) == best
    with pytest.raises(ValueError):
        resharding.min_cost_flow([2], [1], lambda i, j: 0)


def test_reshard(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([5, 50, 500, 4000]), rng.choice([0, 0, 0, 1, 2, 9])) for k in range(3000)] + [(7, 5, 0), (7, 5, 0), (None, 60, 1)]
    df = spark.createDataFrame(rows, "doc_id long, size long, old int").repartition(7)
    order = [F.col("doc_id").asc_nulls_last()]
    placed = resharding.reshard(df, "old", "size", lambda t: resharding.even_capacities(t, 5), order)
    got = placed.toPandas()
    assert Counter(map(str, got[["doc_id", "size", "old"]].values.tolist())) == Counter(map(str, df.toPandas().values.tolist()))
    total = sum(r[1] for r in rows)
    per = got.groupby("shard")["size"].sum()
    assert set(per.index) == set(range(5)) and (abs(per - total / 5) <= 8000).all()
    assert all(sorted(s) == list(range(len(s))) for s in got.groupby("shard")["slot"].agg(list))
    held = Counter()
    for _, s, o in rows:
        held[o] += s
    least = total - sum(min(held[j], total / 5) for j in range(5))
    moved = got.loc[got["old"] != got["shard"], "size"].sum()
    assert abs(moved - least) <= 20_000


def test_rows_of_size_0_are_placed(spark):
    """At the end of a shard's line, and in shards that hold nothing else."""
    rows = [(k, 10 if k % 3 else 0, k % 2) for k in range(60)] + [(100 + k, 0, 2) for k in range(5)] + [(200 + k, 0, 9) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, size long, old int").repartition(3)
    for given in (df, df.withColumn("size", F.lit(0).cast("long"))):
        got = resharding.reshard(given, "old", "size", lambda t: resharding.even_capacities(t, 3), [F.col("doc_id")]).toPandas()
        assert sorted(got["doc_id"]) == sorted(r[0] for r in rows)
        assert all(sorted(s) == list(range(len(s))) for s in got.groupby("shard")["slot"].agg(list))
        assert set(got.loc[got["old"] == 2, "shard"]) == {2}


def size_of(row):
    return F.coalesce(F.col(f"{row}.size"), F.lit(0)).cast("long")


def order_of(row):
    return [F.col(f"{row}.doc_id")]


def moved(spark, rows, capacities, **files):
    old, new = scratch_path(spark, "old"), scratch_path(spark, "new")
    resharding.write_layout(rows, F.col("old"), old)
    found, paths = resharding.reshard_layout(spark, old, rows.schema, size_of, order_of, capacities, new, **files)
    return found.collect(), paths, old, new


def test_layout_is_rewritten(spark):
    """The files hold what the plan says, whatever the names of the columns; repeated rows and nulls are rows like any other."""
    rng = random.Random(6)
    rows = [(k, rng.choice([0, 5, 50, 500, 4000]), rng.choice([0, 0, 0, 1, 2, 9]), f"p{k}", 1) for k in range(1500)]
    rows += [(7, 5, 0, "same", None)] * 5 + [(None, 60, 1, None, 2), (None, None, 1, "é", 2), (1600, 100_000, 2, "x" * 1000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, size long, old int, slot string, place int").repartition(7)
    for files in ({"file_size": 20_000, "file_rows": 1000}, {"file_rows": 50}, {}):
        got, paths, old, new = moved(spark, df, lambda t: resharding.even_capacities(t, 5), **files)
        assert Counter(tuple(r["row"]) for r in got) == Counter(rows)
        slots, filled = {}, Counter()
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
            filled[r["shard"]] += r["row"]["size"] or 0
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(paths) == set(slots) == set(range(5))
        assert all(p.startswith(new) for p in paths.values())
        total = sum(r[1] or 0 for r in rows)
        assert all(abs(n - total / 5) <= 8000 for s, n in filled.items() if s != 2)
        # A slot is the place in the line: rows that stayed stand by size, in one stretch.
        for shard in (0, 1, 2):
            own = [r["row"]["size"] or 0 for r in sorted(got, key=lambda r: r["slot"]) if r["shard"] == shard == r["row"]["old"]]
            assert own == sorted(own, reverse=True)


def test_untouched_shards_stay(spark):
    df = spark.createDataFrame([(k, 10, k % 3 if k % 3 < 2 else 1) for k in range(90)], "doc_id long, size long, old int")
    got, paths, old, new = moved(spark, df, [300, 300, 300])
    assert paths == {0: f"{old}/old=0", 1: f"{new}/shard=1", 2: f"{new}/shard=2"}
    assert Counter(r["row"]["doc_id"] for r in got) == Counter(range(90)) and {r["shard"] for r in got if r["row"]["old"] == 0} == {0}
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(30)) for s in range(3))
    got, paths, old, _ = moved(spark, df, [300, 600])
    assert paths == {0: f"{old}/old=0", 1: f"{old}/old=1"} and len(got) == 90
    got, paths, *_ = moved(spark, df.limit(0), lambda t: resharding.even_capacities(t, 3))
    assert got == [] and paths == {}


def test_query_reshards_whole_texts(spark):
    """Sizes, checksums and shards against the documents themselves, and the moved bytes against the least possible."""
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op3_resharding"](spark, folder).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in texts.items())
    total, held, filled, line, stayed = sum(len(t) + 1 for t in texts.values()), Counter(), Counter(), {}, 0
    for r in got:
        old = zlib.crc32(str(r["doc_id"]).encode()) % OLD_SHARDS
        held[old] += r["size"]
        filled[r["shard"]] += r["size"]
        line.setdefault(r["shard"], []).append(r["slot"])
        stayed += r["size"] if old == r["shard"] else 0
    longest = max(r["size"] for r in got)
    assert all(abs(filled[s] - total / NEW_SHARDS) <= 2 * longest for s in range(NEW_SHARDS))
    assert all(sorted(s) == list(range(len(s))) for s in line.values())
    assert stayed >= sum(min(held[s], total // NEW_SHARDS) for s in range(OLD_SHARDS)) - OLD_SHARDS * longest
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_threshold_algorithm():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, d, k = int(rng.integers(1, 60)), int(rng.integers(0, 5)), int(rng.integers(1, 7))
        vectors, ids = rng.integers(-3, 4, (n, d)).astype(float), rng.permutation(200)[:n]
        query = vectors[0] if rng.random() < 0.5 else rng.integers(-3, 4, d).astype(float)
        lists = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        got = topk.threshold_top_k(query, int(ids[0]), vectors, ids, lists, k, step=int(rng.integers(1, 5)))
        want = sorted((int(-(vectors[i] @ query)), int(ids[i])) for i in range(n) if i)[:k]
        assert got == [(-s, i) for s, i in want]


def test_reading_stops_early():
    """One row beats all others by far, so its lists' heads decide."""
    vectors = np.random.default_rng(1).integers(0, 5, (5000, 3)).astype(float)
    vectors[7] = 1000

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            out = super().__getitem__(key)
            Counted.read += np.size(out)
            return out

    lists = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T).view(Counted)
    assert topk.threshold_top_k(np.array([1.0, 2, 0]), -1, vectors, np.arange(5000), lists, 1, step=8) == [(3000, 7)]
    assert Counted.read < 100


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(300)] + [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(300, 340)]
    bad = [(350, None), (400, [1.0, None, 1.0, 1.0]), (450, [float("nan")] * 4), (500, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    other = [(550, [1.0, 1.0]), (551, [2.0, -1.0]), (600, []), (650, [3e4] * 4)]
    df = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    vectors = topk.quantised(df)
    got = topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5).collect()
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows + other}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors).collect() == [] == topk.top_k(vectors, vectors.limit(0)).collect()


def pages():
    big = "<p>é" + "x" * 300_000
    rows = [(1, "http://a/1", "<p>same"), (2, "http://a/2\r\nbad: header", "<p>same"), (9, None, "<p>same"), (3, "http://é", big), (4, "u", big), (5, "u", None),
            (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (None, "u", "alone"), (None, "u", "with null"), (8, "u", "with null"), (10, "u", "tie"), (10, "v", "tie")]
    return rows


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(df, folder, least, roll_bytes=400)
    got = warc.read_archives(manifest, folder).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(pages()) and manifest.count() > 4
    newest = {}
    for i, _, h in pages():
        newest.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in pages():
        data = (h or "").encode()
        known = [x for x in newest[h or ""] if x is not None]
        keep = max(known, default=None)
        revisit = len(data) >= least and i != keep
        want.append((i, len(data), warc.digest32(data), "revisit" if revisit else "response", keep if revisit else None, None if revisit else data))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in got), key=repr) == sorted(
        ((*w[:5], w[5] or (w[5] if w[5] is None else b"")) for w in want), key=repr)
    assert {r["target_uri"] for r in got if r["page_id"] == 2} == {"http://a/2%0D%0Abad: header"}


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(spark, df).collect() == []


def test_damage_is_noticed():
    good = warc.record(1, "u", b"payload", None, False, "2020-01-01T00:00:00Z")
    assert len(list(warc.read_records(io.BytesIO(good * 3)))) == 3
    plain = zlib.decompress(good, 31)
    pack = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    for bad in (good[:-9], good[:40], pack(plain.replace(b"payload", b"paxload")), pack(plain[:-1]), pack(plain.replace(b"Content-Length: ", b"Content-Length: 9", 1)), b"junk", pack(b"no header")):
        with pytest.raises(warc.DamagedArchive):
            list(warc.read_records(io.BytesIO(bad)))
