"""Periodic runs, projected search and the divergence audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import divergence, periodic, projected_search, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def runs_brute(words):
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        x = 0
        while x < n - q:
            start = x
            while x < n - q and words[x] == words[x + q]:
                x += 1
            length = x - start + q
            stretch = words[start:start + length]
            if length >= max(24, 3 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.append((start, length, q))
            x += x == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def nested(rng):
    """Words with runs inside, beside and across other runs."""
    words = []
    for _ in range(rng.randint(1, 5)):
        base = [rng.randint(0, rng.choice([0, 1, 2, 30])) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 16, 17, 20, 33, 40, 70]))]
        if rng.random() < 0.3:
            base = base + base + [rng.randint(0, 3)]
        words += base * rng.choice([1, 2, 3, 4, 9]) + base[:rng.randint(0, len(base))]
    return words[:600]


def test_runs_of_words():
    rng = random.Random(11)
    for _ in range(300):
        words = nested(rng)
        assert periodic.runs(np.array(words, np.int64)) == runs_brute(words)
    for length in range(20, 30):  # the least length, and the first two periods that need more
        for period in (1, 7, 8, 9):
            words = [k % period for k in range(length)] + [-1]
            assert periodic.runs(np.array(words, np.int64)) == runs_brute(words)
    assert periodic.runs(np.empty(0, np.int64)) == []
    assert periodic.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_periodic_runs_of_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{k}" for k in nested(rng)) for _ in range(40)]
    rows = [*enumerate(texts), (7, "x " * 5000), (7, "x " * 5000), (None, "a\tb\n" * 30), (50, None), (51, ""), (52, " \t"), (53, "É é " * 20), (54, "a" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"runs": F.lit(1), "collapsed": F.lit("c"), "n": F.lit(0)})
    got = sorted(((r["doc_id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.periodic_runs(docs).collect()), key=repr)
    want = []
    for i, text in rows:
        words = WORD.findall(text or "")
        found = runs_brute(words) if len(words) < 4000 else [(0, len(words), 1)]
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        want.append((i, tuple(found), " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_query_of_runs(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for i, text in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        if n > 1500 and h % 10:
            continue  # too long for the brute force and not looped
        found = runs_brute(words)
        with_runs += bool(found)
        best = None
        for r in found:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        gone = {k for s, length, p in found for k in range(s + p, s + length)}
        digests = [hashlib.sha256(t.encode()).hexdigest()
                   for t in ("".join(f"{s},{length},{p}\n" for s, length, p in found), " ".join(w for k, w in enumerate(words) if k not in gone))]
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[i] == (len(found), *figures, *digests)
    assert with_runs > 5


def vector_rows():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, 24))
    vectors[300:600] = vectors[:3].repeat(100, 0) + 0.05 * rng.normal(size=(300, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[7].tolist()) for i in range(400)]  # one hot vector
    rows += [rows[5], rows[5], (100, vectors[4].tolist())]  # repeated rows; an id with two vectors
    rows += [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [float("inf")] + [1.0] * 23), (2400, [None] + [1.0] * 23), (None, [1.0] * 24)]
    return rows + [(3000, [1.0, 2.0]), (3001, [1.0, 3.0]), (3100, [-0.0, 2.0]), (3101, [0.0, 2.0]), (3200, [])]


@pytest.mark.parametrize("shape", [{}, {"sample": 256, "sample_cell": 16, "cell_vectors": 20}])
def test_nearest(spark, shape):
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumns({"cell": F.lit(1), "query": F.lit("q"), "dims": F.lit(0)})
    got = defaultdict(dict)
    for r in projected_search.nearest(table.filter("vec_id % 100 = 0"), table, **shape).collect():
        got[r["query_id"]].setdefault(r["rank"], []).append((r["score"], r["vec_id"]))
    usable = sorted({(i, tuple(x + 0.0 for x in v)) for i, v in rows
                     if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    found = wanted = 0
    for i, v in usable:
        if i % 100:
            continue
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in usable if len(w) == len(v) and (j, w) != (i, v))[:10]
        hits = [hit for rank in sorted(got[i]) for hit in got[i][rank]]
        assert len(hits) == sum(min(10, sum(len(w) == len(u) for _, w in usable) - 1) for j, u in usable if j == i)
        found += sum(any(j == b and abs(d - a) < 1e-12 for a, b in hits) for d, j in near)
        wanted += len(near)
    assert found / wanted >= 0.9
    hot = [hit for rank in sorted(got[1100]) for hit in got[1100][rank]]
    assert hot == [(0.0, 7), *((0.0, 1000 + k) for k in range(9))]  # ties by id
    assert set(got) == {i for i, _ in usable if i % 100 == 0}
    empty = table.limit(0)
    assert projected_search.nearest(empty, table).collect() == [] and projected_search.nearest(table, empty).collect() == []


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = defaultdict(list)
    for r in queries.QUERIES["op12_projected_search"](spark, folder).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == set(ids[ids % 100 == 0].tolist())
    found = 0
    for q, hits in got.items():
        away = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        near = [k for k in np.lexsort((ids, away)) if ids[k] != q][:10]
        assert hits == sorted(hits) and len(hits) == 10
        found += len({int(ids[k]) for k in near} & {i for _, i in hits})
    assert found >= 0.9 * 10 * len(got)


def test_chi_square_limit():
    """Values of printed tables."""
    assert projected_search.chi_square_limit(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert projected_search.chi_square_limit(0.99, 2) == pytest.approx(9.210, abs=1e-3)


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence_brute(rows, top=200):
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = []
    for lang in {k[0] for k in counts}:
        kept = sorted(t for t, n in documents[lang].items() if n >= 3)

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 1) // (total + len(kept)) for t in kept}

        own = {s: shares(c) for (of, s), c in counts.items() if of == lang}
        whole = shares(sum((c for (of, _), c in counts.items() if of == lang), Counter()))
        for s, p in own.items():
            for part, values in (("pair", {o: sum((p[t] - q[t])**2 // q[t] for t in kept) for o, q in own.items() if o != s}),
                                 ("term", {t: (p[t] - whole[t])**2 // whole[t] for t in kept if counts[lang, s][t] and p[t] > whole[t]})):
                ranked = sorted(values.items(), key=lambda item: (-item[1], item[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit_rows():
    rng = random.Random(7)
    vocabulary = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghij", "Éa", "é", "日本語" * 9, "x" * 40, "x" * 41, "CASE", "case", *(f"w{'abcdefghij'[k]}" * (k + 1) for k in range(10))]
    rows = [(" 1".join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s1", "s2", "Ä", None])) for _ in range(150)]
    rows += [(None, "en", "only null"), ("", "xx", "s1"), ("12 !", "xx", "s2"), ("rare", "yy", "s1"), ("z" * 100_000, "en", "s1")]
    return rows + [("same row of text", "zz", "s")] * 3 + [("same row", "zz", "t")]


@pytest.mark.parametrize("part_bytes", [100, 1 << 24])
def test_divergence(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(divergence, "PART_BYTES", part_bytes)
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6).withColumns({"term": F.lit("t"), "n": F.lit(1), "head": F.lit(2)})
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == divergence_brute(rows)
    assert sorted(map(tuple, divergence.divergence(docs, top=2).collect())) == divergence_brute(rows, 2)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_refined_counts_documents_of_prefixes(spark):
    """A prefix that several rare terms share lives on, its extensions go."""
    texts = [b"prefixab prefix", b"prefixbb prefix", b"prefixcb", b"prefix PREFIX", b"prefixabcdefghijkl", b"prefixabcdefghijkm", b"prefixabcdefghijkn prefixabcdefghijkm"]
    parts = [divergence._summed_part(["g"] * len(part), ["s"] * len(part), part, 4) for part in (texts[:3], texts[3:])]
    for part in parts:  # every document counts once for a prefix
        lists = dict(zip(part.column("term").to_pylist(), part.column("prefix_documents").to_pylist()))
        assert sum(v[0] for v in lists.values()) == len(texts[:3] if b"prefixcb" in lists else texts[3:])
    kept = divergence.refined(spark.createDataFrame(divergence.pa.Table.from_batches(parts)), 3, 18, 4)
    assert {(r["lang"], bytes(r["term"])) for r in kept.collect()} == {("g", b"prefix")}
