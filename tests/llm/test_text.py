"""Language identification, merge-dropout, personal data and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabwright.llm import langid, pieces, pii
from tabwright.llm.queries import MODEL_FILE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def naive_phrases(text, sample):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at:at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    # A phrase counts when the next one begins, and an unknown byte at once.
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(1)
    for _ in range(60):
        sample = bytes(rng.choices(b"abcd", k=rng.randrange(1, 80)))
        parser = langid.Parser.of("x", sample)
        texts = [bytes(rng.choices(b"abcde", k=rng.choice([0, 1, 5, 60, 300]))) for _ in range(rng.randrange(1, 60))]
        got = parser.phrases(texts)
        for text, n in zip(texts, got):
            ends = naive_phrases(text, sample)
            # The last phrase is not closed unless its last byte is unknown.
            assert n in (ends, ends - 1) and abs(n - ends) <= 1


def test_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("score", F.lit("clash"))
    samples = langid.learn(docs)
    assert all(len(s) <= langid.SAMPLE_BYTES + langid.SAMPLE_DOCS for s in samples.values())
    found = langid.identify(docs, samples, carry=["doc_id", "lang"]).withColumn("held_out", langid.held_out(F.col("doc_id"))).toPandas()
    held = found[found["held_out"]]
    assert len(held) > 20 and (held["lang"] == held["lang_pred"]).mean() >= 0.98
    assert found["score"].between(0, 1).all()
    odd = [(1, None, "en"), (2, "", "en"), (3, "123 .,!?", None), (4, "the " * 50_000, None), (None, "le la des que", None), (4, "x", None)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    got = langid.identify(frame, samples).collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, True, True, False, False, False]
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    assert {r["lang_pred"] for r in langid.identify(frame, langid.learn(frame.filter("doc_id = 3"))).collect()} == {"und"}
    assert langid.learn(docs.limit(0)) == {} and langid.identify(docs.limit(0), samples).collect() == []


def test_samples_come_from_whole_texts(spark, monkeypatch):
    """Excerpts lie anywhere, few documents share all the bytes, and languages without any are named."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(4)
    long = " ".join("".join(rng.choices(letters, k=5)) for _ in range(20_000))
    monkeypatch.setattr(langid, "held_out", lambda doc_id: F.lit(False))
    rows = [(1, "0 1 2 " * 500 + long, "rare"), (2, long[::-1], "rare"), (3, "x " + "7" * 400_000, "digits")] + [(k, f"word{letters[k % 26]} of many", "many") for k in range(10, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="digits"):
        samples = langid.learn(docs)
    assert set(samples) == {"rare", "many"}
    assert langid.SAMPLE_BYTES * 0.9 <= len(samples["rare"]) <= langid.SAMPLE_BYTES + 1
    assert samples["rare"][:500].decode().strip() not in long[:5000]
    assert langid._shared([b"ab", b"", b"x" * 90, b"y" * 50], 100) == [b"ab", b"x" * 49, b"y" * 49]
    short = spark.createDataFrame([(1, "x", None), (2, "漢", None), (3, "7", None), (4, None, None), (5, "漢字仮名交じり文と句読点" * 9, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in langid.recognised(docs.union(short)).collect()} >= {1, 2}
    assert not {3, 4, 5} & {r["doc_id"] for r in langid.recognised(docs.filter("doc_id > 3").union(short)).collect()}


def test_recognised_rows_keep_their_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns({"bits": F.lit("clash"), "lang_pred": F.lit(1)})
    odd = docs.limit(3).withColumns({"lang": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10**6, "text": F.lit("漢字仮名交じり文と句読点、記号だけ。" * 30)})
    kept = langid.recognised(docs.union(odd).union(odd.withColumn("text", F.lit(None).cast("string"))))
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def sample_texts(n=120):
    import pyarrow.parquet as pq

    return pq.read_table(f"{FOLDER}/documents.parquet").column("text").to_pylist()[:n]


ODD = ["", "a  b\n c▁d é漢\U0001f600", "   ", "x" * 500 + " " + "é" * 100, "\n\n a", "\x00\t  tab ", " lead", "trail  ", "▁", "<0x41> <s> </s>", "word " * 3000]


def test_without_dropout_ids_are_the_models():
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    own = [t for t in sample_texts() + ODD if "▁" not in t]
    got = pieces.Encoder(pieces.load(MODEL_FILE), 0, 0, 0.0).encode(own)
    assert [g.tolist() for g in got] == model.encode(own)


def test_dropout_follows_the_definition(monkeypatch):
    """Many at a time, the agenda, and a plain search for the best candidate agree."""
    vocabulary = pieces.load(MODEL_FILE)
    units = sorted({u for t in sample_texts(6) + ODD for u in pieces._UNIT.findall(" " + t) if len(u) < 60})[:400]
    symbols, lengths = vocabulary.symbols(units)
    keys, ends = pieces.unit_keys(symbols, lengths, 1, 7), np.cumsum(lengths)
    encoder = pieces.Encoder(vocabulary, 1, 7, 0.2)
    encoder._learn(units)
    for unit, stop, n, key in zip(units, ends, lengths, keys):
        own = symbols[stop - n:stop].tolist()
        k = encoder.place[unit]
        agenda = pieces.agenda_merge(vocabulary, own, int(key), 0.2)
        assert encoder.ids[encoder.ends[k]:encoder.ends[k + 1]].tolist() == agenda
        current = [(s, i, i + 1) for i, s in enumerate(own)]
        while True:
            best = None
            for k in range(len(current) - 1):
                to = int(vocabulary.merge(np.array([current[k][0]]), np.array([current[k + 1][0]]))[0])
                place = [np.array([x]) for x in (current[k][1], current[k][2], current[k + 1][2])]
                if to >= 0 and not pieces.skipped(np.array([key]), *place, 0.2)[0] and (best is None or -vocabulary.score[to] < best[0]):
                    best = (-vocabulary.score[to], k, to)
            if best is None:
                break
            k = best[1]
            current[k:k + 2] = [(best[2], current[k][1], current[k + 1][2])]
        assert [c[0] for c in current] == agenda
    monkeypatch.setattr(pieces, "SECTION", 700)
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    again = pieces.Encoder(vocabulary, 1, 7, 0.2).encode(sample_texts(20))
    monkeypatch.undo()
    assert all(np.array_equal(a, b) for a, b in zip(again, pieces.Encoder(vocabulary, 1, 7, 0.2).encode(sample_texts(20))))


def test_round_trip(spark):
    rows = list(enumerate(ODD + [None] + sample_texts(30))) + [(None, "no id"), (3, "repeated"), (3, "repeated")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    encoded = pieces.encode(docs, MODEL_FILE, dropout=0.3)
    back = pieces.decoded(encoded, MODEL_FILE).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(rows)
    assert all((r["ids"] is None) == (r["text"] is None) for r in back)
    ids = {r["doc_id"]: r["ids"] for r in back}
    same = {r["doc_id"]: r["ids"] for r in pieces.encode(docs.repartition(3), MODEL_FILE, dropout=0.3).collect()}
    other = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, MODEL_FILE, dropout=0.3, seed=1).collect()}
    assert ids == same and ids != other
    assert pieces.encode(docs.limit(0), MODEL_FILE).collect() == []
    variety = pieces.encode(spark.createDataFrame([(k, "internationalisation of words") for k in range(40)], "doc_id long, text string"), MODEL_FILE, dropout=0.3)
    assert 1 < len({tuple(r["ids"]) for r in variety.collect()}) <= pieces.VARIANTS


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def accepted(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        doubled = [int(c) * 2 - 9 * (c > "4") if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if accepted(kind, m.group()))
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in found)


def noisy_texts(n=400):
    rng = random.Random(9)
    parts = ["a", "b.c", "@", ".", "1", "22", "255", "256", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "é", "\U0001f600", "_", "x@y.z", "+49 30 123456", "1.2.3.4", "00"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(n)]


def test_rules(spark):
    long = ["9" * 4000 + " " + "a" * 4000 + "@" + "x" * 3000, "1." * 3000, "+1" + " " * 5000, "1 " * 6000, "a@b." * 500]
    rows = list(enumerate(noisy_texts() + long + [None, ""]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit("clash"), "m_": F.lit(1)})
    got = pii.detect(docs, pii.Detector()).select("doc_id", pii.spans_text(F.col("base")).alias("b"), pii.spans_text(F.col("spans")).alias("s"), "m_")
    assert {r["doc_id"]: (r["b"], r["s"]) for r in got.collect()} == {i: (plain_spans(t),) * 2 for i, t in rows}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail x@y.zz, call +49 30 123456!"), (2, None), (3, "nothing")], "doc_id long, text string")
    got = pii.detect(docs, pii.Detector()).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in got.collect()} == {1: "é mail <email>, call <phone>!", 2: None, 3: "nothing"}


def test_trees_add_what_resembles_the_known(spark):
    """Phone numbers without a plus resemble those with one; plain numbers do not, and rules always stay."""
    rng = random.Random(3)
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = []
    for k in range(900):
        kind = k % 3
        rows.append((k, f"please call phone +1 {number()} today {k}" if kind == 0 else f"order of {rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(100, 999)} items {k}" if kind == 1
                     else f"text without any {k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    detector = pii.fit(docs)
    assert detector.trees and detector.thresholds[3] <= 1 and detector.thresholds[0] > 1
    again = pii.fit(docs.repartition(3))
    assert again.trees == detector.trees and again.thresholds == detector.thresholds
    odd = [(1, "please call phone 1 (269) 555-3296 today"), (2, "order of 12 345 678 items"), (3, "call +1 (269) 555-3296"), (4, None)]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(odd, "doc_id long, text string"), detector).collect()}
    assert [s["found"] for s in got[1]["spans"]] == ["(269) 555-3296"] and not got[1]["base"]
    assert got[2]["spans"] == [] and got[3]["spans"] == got[3]["base"] and got[4]["spans"] == []


def test_trees_learn_from_every_document_once(spark, monkeypatch):
    """All texts are looked at, however many there are, and copies change neither trees nor thresholds."""
    seen, look = [], pii.with_candidates
    monkeypatch.setattr(pii, "with_candidates", lambda docs: seen.append(docs.count()) or look(docs))
    docs = spark.range(9_000).selectExpr("id AS doc_id", """CASE id % 3 WHEN 0 THEN concat('please call phone +1 (', 200 + id % 700, ') 555-', 1000 + id, ' today')
        WHEN 1 THEN concat('order of ', 10 + id % 90, ' ', 100 + id % 900, ' ', 100 + id % 800, ' items ', id) ELSE concat('text without any ', id) END AS text""")
    detector = pii.fit(docs)
    assert seen == [9_000] and detector.trees and detector.thresholds[3] <= 1
    assert pii.fit(docs.unionByName(docs.filter("doc_id % 2 = 0"))) == detector


def planted_documents(n):
    """Plain personal data, the same in other forms, and numbers and words that look alike: texts and what is planted besides the plain forms."""
    rng = random.Random(17)
    some = lambda *options: rng.choice(options)
    digits = lambda k: "".join(str(rng.randrange(10)) for _ in range(k - 1)) + str(rng.randrange(1, 10))
    name = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 9)))
    filler = lambda: " ".join(name() for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(n):
        host, parts = f"{name()}.{some('com', 'org', 'net')}", [str(rng.randrange(256)) for _ in range(4)]
        area, middle, last = str(rng.randrange(200, 999)), str(rng.randrange(200, 999)), str(rng.randrange(1000, 9999))
        mail, call, login = some("write an email to", "contact", "mail"), some("call", "phone me on", "my mobile is"), some("the server", "login from host", "ip")
        v6 = ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8))
        cue, plain, other = [
            (mail, f"{name()}@{host}", f"{name()} [at] {host.replace('.', some(' [dot] ', ' dot '))}"),
            (call, f"+1 ({area}) {middle}-{last}", some(f"({area}) {middle}-{last}", f"{area}-{middle}-{last}")),
            (login, ".".join(parts), v6)][i % 3]
        kind = i // 3 % 6
        if kind == 0:
            rows.append((f"{filler()} {cue} {other} {filler()}", other))
        elif kind in (1, 2):
            rows.append((f"{filler()} {cue} {plain} {filler()}", None))
        elif kind == 3:
            number = some(f"{area}-{middle}-{last}", f"12:{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(4)}.{digits(4)}.{digits(4)}")
            rows.append((f"{filler()} {some('part', 'order', 'lot')} {number} {filler()}", None))
        else:
            rows.append((f"{filler()} look at {name()} {name()} {digits(3)} {digits(4)} {digits(4)}", None))
    return rows


def test_trees_find_forms_the_rules_cannot_name(spark):
    texts = planted_documents(5400)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    detector = pii.fit(docs.filter("doc_id < 3600"))
    assert [t <= 1 for t in detector.thresholds] == [True, True, False, True]
    caught = planted = added = 0
    for r in pii.detect(docs.filter("doc_id >= 3600"), detector).collect():
        text, form = texts[r["doc_id"]]
        assert pii_text(r["base"]) == plain_spans(text)
        more = [s["found"] for s in r["spans"] if s not in r["base"]]
        assert all(text[s["start"]:s["stop"]] == s["found"] for s in r["spans"])
        planted, caught, added = planted + (form is not None), caught + (form in more), added + len(more)
    assert planted == 300 and caught >= 0.9 * planted and caught >= 0.95 * added


def pii_text(spans):
    return ",".join(f"{pii.KINDS[s['kind']]}:{s['start']}:{s['stop']}" for s in spans)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert pii.fit(docs).trees == [] and pii.fit(docs.limit(0)).trees == []
    assert pii.detect(docs.limit(0), pii.Detector()).collect() == []


def test_pii_query_matches_the_rules(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op7_pii"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) - {""} <= set(r["spans"].split(","))


def test_pipeline(spark):
    """Every stage against what brute force leaves of its own input."""
    from test_copies import WORD
    from test_near import components_brute

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append({r["doc_id"]: r["text"] for r in docs.collect()})
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toArrow())
        assert docs.columns == columns or name == "merge_dropout"
    assert set(inputs[1]) == {i for i, t in inputs[0].items() if any(c.isalpha() for c in t or "")}
    newest = {}
    for i, t in inputs[1].items():
        newest[t.encode().lower()] = max(i, newest.get(t.encode().lower(), i))
    assert set(inputs[2]) == set(newest.values())
    assert set(inputs[3]) == {i for i, _, c in components_brute(list(inputs[2].items()), 5, 80) if i == c}
    assert set(inputs[4]) <= set(inputs[3]) and all(inputs[4][i] == inputs[3][i] for i in inputs[4])
    final = docs.collect()
    words = sum(len(WORD.findall(inputs[4][r["doc_id"]])) for r in final)
    assert words == pytest.approx(sum(len(WORD.findall(t)) for t in inputs[3].values()), rel=0.3)
    assert max(Counter(r["doc_id"] for r in final).values()) <= 3
    repeated = defaultdict(list)
    for r in final:
        repeated[r["doc_id"]].append(tuple(r["ids"]))
    long = [ids for i, ids in repeated.items() if len(ids) > 1 and len(inputs[4][i]) > 2000]
    assert long and all(len(set(ids)) == len(ids) for ids in long)  # drawn copies differ
    vocabulary = pieces.load(MODEL_FILE)
    assert all(pieces.decode(vocabulary, r["ids"]) == inputs[4][r["doc_id"]] for r in final)


def test_queries_are_registered(spark):
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert {n for n in names if n.startswith("op")} == set(QUERIES) and "pipeline" in names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op6_warc", "op10_top_k", "op13_divergence"])
def test_sql(spark, name):
    from compare import connect, difference

    from tabwright.llm.queries import ORACLES

    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


HELPERS = ["copy_", "drawn_", "times_", "taken_", "row_key_", "stays_", "kept_id", "kept_sha", "own", "own_id", "own_row", "own_sha", "whole", "row",
           "key", "place", "keys0", "node", "digest", "variant_", "copy", "block", "size", "before", "shard", "slot"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_name(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in HELPERS})
    name, run = corpus_pipeline.STAGES[stage]
    kept = run(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all(r[name] == f"{name}{r['doc_id']}" for r in rows for name in HELPERS)


def test_copies_and_missing_ids_choose_their_segmentation(spark):
    text = "the quick brown fox jumps over lazy dogs and internationalisation " * 5
    rows = [(1, text, c) for c in range(4)] + [(None, text, 0), (None, text + "again", 0), (2, None, None), (3, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy int")
    got = pieces.encode(docs, MODEL_FILE, carry=["doc_id", "text"], copy="copy").collect()
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] == 1}) == 4
    assert [r["ids"] for r in got if r["doc_id"] in (2, 3)] == [None, []]
    vocabulary = pieces.load(MODEL_FILE)
    assert all(pieces.decode(vocabulary, r["ids"]) == r["text"] for r in got if r["text"])
    assert len({tuple(r["ids"]) for r in pieces.encode(docs.filter("doc_id = 1"), MODEL_FILE).collect()}) == 1
    assert pieces.encode(docs.limit(0), MODEL_FILE, copy="copy").collect() == []
    with pytest.raises(ValueError, match="ids"):
        pieces.encode(docs.withColumn("ids", F.lit(1)), MODEL_FILE, carry=["ids"])
