"""Near copies: rows without an id, ids with several texts, and the rule of the pipeline's stage."""

import random
from collections import Counter

import corpus_pipeline
from tabwright.llm import ngram_join
from test_copies import LOWER, WORD, frame, near_rows


def shingles_of(text, words):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[k:k + words]) for k in range(len(found) - words + 1))


def components_brute(rows, words, percent):
    """The smallest known doc_id that each row reaches."""
    sets = [shingles_of(t, words) for _, t in rows]
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
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


def replaced(words, *places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


def test_stage_takes_five_words_and_four_fifths(spark):
    rng = random.Random(8)
    rows = []
    for family in range(12):
        words = [f"f{family}w{k}" for k in range(rng.choice([4, 20, 60, 100, 250]))]
        rows += [(len(rows) + k, replaced(words, *rng.sample(range(len(words)), rng.randint(0, max(1, len(words) // 25))))) for k in range(6)]
    plain = [f"w{k}" for k in range(100)]
    rows += [(500, replaced(plain)), (501, replaced(plain, 30, 60)), (502, None), (503, "")]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    assert kept == {i for i, _, c in components_brute(rows, 5, 80) if i == c}
    assert 500 in kept and 501 not in kept
    assert kept != {i for i, _, c in components_brute(rows, 3, 90) if i == c}


def test_rows_without_an_id_and_ids_with_two_texts(spark):
    def words(name, n=200):
        return [f"{name}{k}" for k in range(n)]

    a, x, y, z = words("a"), words("x"), words("y"), words("z")
    rows = near_rows(families=4) + [
        (3000, replaced(a)), (None, replaced(a, 20, 90)), (3001, replaced(a, 20, 90, 40, 60, 120)),  # only the row without an id links the others
        (3050, replaced(x)), (3100, replaced(x, 50)), (3100, replaced(y)), (3200, replaced(y, 50)), (None, replaced(y, 70)),
        (None, replaced(z)), (None, replaced(z, 9)), (None, None), (None, "")] + [(None, "a text of its own")] * 30
    want = components_brute(rows, 3, 90)
    got = ngram_join.jaccard_components(frame(spark, rows), task_shingles=1000)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {c for i, _, c in want if i in (3000, 3001)} == {3000}
    kept = ngram_join.representatives(frame(spark, rows))
    assert Counter(map(tuple, kept.collect())) == Counter(r for r, (i, _, c) in zip(rows, want) if i == c)
