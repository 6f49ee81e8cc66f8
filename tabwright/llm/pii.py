"""Personal data: rules, and gradient-boosted trees that choose among further candidates.

High-recall generators propose overlapping spans. What the rules accept stays; trees boosted on format and context score the other
candidates, and a calibrated threshold per kind selects from them. Accepted spans, rewritten into forms that the rules cannot name, are what
the trees learn from. All of it is expressions in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.storage import written

KINDS = ("email", "ip", "card", "phone")

# The rules, written so that no text makes them slow: a run that cannot match is tried once (from its start, or from
# where the last match ended), and repetitions that nothing follows give nothing back. They match what the plain forms match.
_LOCAL = "A-Za-z0-9._%+-"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
RULES = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a rule to apply at all.
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Generators beyond the rules: kind and pattern. Each is bounded in length, so they are quick on any text.
GENERATORS = (
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}(?:@|\x20?[\[({{]\x20?(?:at|AT)\x20?[\])}}]\x20?)[A-Za-z0-9-]{{2,63}}"
              r"(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]{2,63}){0,4}"),
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20(?:at|AT)\x20[A-Za-z0-9-]{{2,63}}+(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]{{2,63}}+){{1,4}}"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:[.,]\x20?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{2,6}){2,4}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
)

_SPAN = "struct<kind:int,start:int,stop:int,found:string>"
_SPANS = f"array<{_SPAN}>"
#: Characters before and after a candidate that count as its context.
CONTEXT = 24
_CUES = {"email": "mail|contact|write|address", "ip": r"\bip\b|host|server|address|login", "card": "card|visa|master|credit|pay",
         "phone": "phone|tel|call|mobile|fax|ring"}

TREES, DEPTH, STEP = 10, 3, 0.3
#: At a threshold, so many of the accepted calibration candidates are right, and so many of the right ones are accepted.
PRECISION, RECALL = 0.98, 0.95
LEAST_KNOWN = 20
#: Different feature vectors that one task of a fit holds, decimal places of a probability (so that calibration collects few values).
TASK_VECTORS, PLACES = 200_000, 5


def _span(kind: Column, start: Column, stop: Column, found: Column) -> Column:
    return F.struct(kind.cast("int").alias("kind"), start.cast("int").alias("start"), stop.cast("int").alias("stop"), found.alias("found"))


def _placed(matches: Column, gaps: Column, kind: int) -> Column:
    """Matches and the gaps around them, turned into spans by code points."""
    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        stop = start + F.length(x["m"])
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(_span(F.lit(kind), start, stop, x["m"]))).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, none, add, lambda acc: acc["spans"])).otherwise(F.array().cast(_SPANS))


def _matched(df: DataFrame, name: str, kind: int, pattern: str, hint: str | None = None) -> DataFrame:
    """Add the column ``name`` with the leftmost non-overlapping matches of ``pattern``."""
    text, empty = F.col("body_"), F.array().cast("array<string>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if hint:
        matches = F.when(F.contains(text, F.lit(hint)), matches).otherwise(empty)
    df = df.withColumn("m_", matches)
    df = df.withColumn("g_", F.when(F.size("m_") > 0, F.split(text, pattern, -1)).otherwise(empty))
    return df.withColumn(name, _placed(F.col("m_"), F.col("g_"), kind)).drop("m_", "g_")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.rlike(found, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _accepts(kind: str, yes: bool):
    return lambda s: _valid(kind, s["found"]) == yes


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def _in_order(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["kind"] != b["kind"], a["kind"] - b["kind"])
                        .otherwise(a["stop"] - b["stop"]))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def with_candidates(docs: DataFrame) -> DataFrame:
    """Add ``base`` (what the rules accept, by start and kind) and ``candidates`` (what generators propose beside it)."""
    df = docs.withColumn("body_", F.coalesce(F.col("text").cast("string"), F.lit("")))
    names, refused = [], []
    for k, kind in enumerate(KINDS):
        df = _matched(df, f"raw_{kind}_", k, RULES[kind], _HINTS[kind])
        names.append(F.filter(f"raw_{kind}_", _accepts(kind, True)))
        refused.append(F.filter(f"raw_{kind}_", _accepts(kind, False)))
    for g, (kind, pattern) in enumerate(GENERATORS):
        df = _matched(df, f"more_{g}_", KINDS.index(kind), pattern)
    df = df.withColumn("base", _in_order(F.concat(*names)))
    proposed = F.array_distinct(F.concat(*refused, *(F.col(f"more_{g}_") for g in range(len(GENERATORS)))))
    df = df.withColumn("candidates", F.filter(proposed, lambda c: ~F.exists("base", lambda b: _overlaps(b, c))))
    return df.drop(*(f"raw_{k}_" for k in KINDS), *(f"more_{g}_" for g in range(len(GENERATORS))))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _count(found: Column, mark: str) -> Column:
    return (F.length(found) - F.length(F.replace(found, F.lit(mark), F.lit("")))).cast("double")


def _before(c: Column, text: Column) -> Column:
    return F.lower(F.substr(text, F.greatest(c["start"] - CONTEXT + 1, F.lit(1)), F.least(c["start"], F.lit(CONTEXT))))


def _has_cue(c: Column, text: Column) -> Column:
    """Whether words that go with the candidate's kind stand before it."""
    before, chosen = _before(c, text), F
    for k, kind in enumerate(KINDS):
        chosen = chosen.when(c["kind"] == k, F.rlike(before, F.lit(_CUES[kind])))
    return chosen


def _features(c: Column, text: Column) -> list[Column]:
    """Format and context of a candidate. Where it stands is that of the span it was rewritten from, if it was."""
    found, before, after = c["found"], _before(c, text), F.substr(text, c["stop"] + 1, F.lit(1))
    length, digits = F.length(found).cast("double"), F.length(_digits(found)).cast("double")
    checked = F.when((c["kind"] == KINDS.index("card")) & digits.between(12, 19), _luhn(_digits(found))).otherwise(F.lit(False))
    return [*(_flag(c["kind"] == k) for k in range(len(KINDS))), length, digits, digits / length, *(_count(found, mark) for mark in " .-:,"),
            _flag(F.contains(found, F.lit("@"))), _flag(F.contains(found, F.lit("("))), F.length(F.regexp_extract(found, "^[0-9]*", 0)).cast("double"),
            F.length(F.regexp_extract(found, "[0-9]*$", 0)).cast("double"), _flag(F.rlike(found, F.lit(r"(?i)\bdot\b"))), _flag(checked),
            _flag(F.rlike(before, F.lit(r"\w$"))), _flag(F.rlike(before, F.lit(r"\s$"))), _flag(F.rlike(after, F.lit(r"\w"))), _flag(F.rlike(after, F.lit(r"\s"))),
            *(_flag(F.rlike(before, F.lit(_CUES[k]))) for k in KINDS)]


def _rewritten(c: Column) -> Column:
    """An accepted span in a form that the rules cannot name (which one, a hash of the span tells); null where its length allows none."""
    found, digits, turn = c["found"], _digits(c["found"]), F.pmod(F.xxhash64(c["found"], c["start"]), F.lit(4))
    local, host = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)

    def spelled(dot: str) -> Column:
        return F.replace(host, F.lit("."), F.lit(dot))

    email = (F.when(turn == 0, F.concat(local, F.lit(" [at] "), spelled(" [dot] "))).when(turn == 1, F.concat(local, F.lit(" [at] "), spelled(" dot ")))
             .when(turn == 2, F.concat(local, F.lit(" at "), spelled(" dot "))).otherwise(F.concat(local, F.lit("(at)"), host)))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(F.sha2(found, 256), 4 * i + 1, F.lit(4)), "^0{1,3}", ""))
    ip = F.when(turn < 3, F.array_join(groups, ":")).otherwise(F.replace(found, F.lit("."), F.lit(",")))
    fours = F.when(turn < 2, F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1.")).otherwise(F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1/"))
    card = F.when(F.pmod(F.length(digits), F.lit(4)) != 1, fours)
    long = F.length(digits) >= 10
    area, middle, last = F.when(long, F.substring(digits, -10, 3)).otherwise(F.substring(digits, -9, 2)), F.substring(digits, -7, 3), F.substring(digits, -4, 4)
    country = F.substr(digits, F.lit(1), F.length(digits) - 10)
    phone = (F.when(turn == 0, F.concat(F.lit("("), area, F.lit(") "), middle, F.lit("-"), last)).when(turn == 1, F.concat_ws("-", area, middle, last))
             .when((turn == 2) & F.length(digits).between(11, 13), F.concat(F.lit("00"), F.concat_ws(" ", country, area, middle, last)))
             .otherwise(F.concat_ws(".", area, middle, last)))
    forms = F.when(c["kind"] == 0, email).when(c["kind"] == 1, ip).when(c["kind"] == 2, card).otherwise(phone)
    return _span(c["kind"], c["start"], c["stop"], forms)


@dataclass
class Detector:
    """Boosted trees as ``(weight, node)`` and a threshold per kind; a node is a leaf value or ``(feature, split, left, right)``."""

    trees: list[tuple[float, object]] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))

    def probability(self, features: Column) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, split, left, right = node
            return F.when(F.get(features, F.lit(feature)) <= split, walk(left)).otherwise(walk(right))

        margin = F.lit(0.0)
        for weight, node in self.trees:
            margin = margin + weight * walk(node)
        return F.round(1 / (1 + F.exp(-2 * margin)), PLACES)


def _node(node) -> object:
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    return int(node.split().featureIndex()), float(node.split().threshold()), _node(node.leftChild()), _node(node.rightChild())


def _vectors(docs: DataFrame) -> DataFrame:
    """What all texts have to learn from: ``label, kind, sure, third, f0, f1, ...`` and ``n``, how often the different texts have it.

    Texts are told apart by a digest, so only spans are shuffled and copies of a text count once.
    """
    found = with_candidates(docs.select(F.col("text").cast("string").alias("text")))

    def wrong(s: Column) -> Column:
        refused = F.lit(False)
        for k, kind in enumerate(KINDS):
            if kind != "email":
                refused = refused | ((s["kind"] == k) & F.rlike(s["found"], F.lit(f"^(?:{RULES[kind]})$")))
        return F.struct(s.alias("c"), F.lit(0.0).alias("label"), (refused | ~_has_cue(s, F.col("body_"))).alias("sure"))

    right = F.filter(F.transform("base", _rewritten), lambda s: s["found"].isNotNull())
    labelled = F.concat(F.transform(right, lambda s: F.struct(s.alias("c"), F.lit(1.0).alias("label"), F.lit(True).alias("sure"))), F.transform("candidates", wrong))
    rows = found.select("body_", labelled.alias("labelled")).filter(F.size("labelled") > 0).select(
        "body_", F.md5("body_").alias("digest"), F.pmod(F.xxhash64("body_", F.lit(8)), F.lit(3)).alias("third"), F.explode("labelled").alias("x"))
    described = [f.alias(f"f{k}") for k, f in enumerate(_features(F.col("x.c"), F.col("body_")))]
    place = [F.col("x.c.start").alias("start"), F.col("x.c.stop").alias("stop"), F.col("x.c.found").alias("found")]
    rows = rows.select("digest", *place, F.col("x.label").alias("label"), F.col("x.c.kind").alias("kind"), F.col("x.sure").alias("sure"), "third", *described)
    once = rows.dropDuplicates(["digest", "start", "stop", "found", "label", "kind"]).drop("digest", "start", "stop", "found")
    return once.groupBy(*once.columns).agg(F.count(F.lit(1)).cast("double").alias("n"))


def fit(docs: DataFrame, precision: float = PRECISION) -> Detector:
    """Fit the trees on every document and calibrate a threshold per kind.

    What the rules accept, rewritten into other forms in its own place, is right; candidates beside it count as wrong while fitting. A few of
    them are right, too, so calibration counts as wrong only those that the rules refuse or that no word of their kind precedes. On a third of
    the texts that the trees have not seen, a threshold is the lowest with a precision of at least ``precision``, or a higher one that still
    accepts ``RECALL`` of the right ones. A kind with fewer than ``LEAST_KNOWN`` right ones accepted, or without such a threshold, adds nothing;
    neither does anything where the texts have one class only.
    """
    vectors = written(_vectors(docs), "pii-vectors")
    many = vectors.count()
    inputs = [c for c in vectors.columns if c not in ("label", "kind", "sure", "third", "n")]
    # In a fixed order, so that a rerun fits the same trees. Equal vectors are one weighted row.
    rows = vectors.repartition(many // TASK_VECTORS + 1, *inputs).sortWithinPartitions(*vectors.columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ready = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
        training, test = ready.filter("third > 0"), ready.filter("third = 0")
        if training.select("label").distinct().count() < 2:
            return Detector()
        # Spark takes candidate splits from a sample of about the square of the bins, so with so many bins from all vectors.
        bins = max(32, math.isqrt(many) + 1)
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=bins, weightCol="n", seed=1).fit(training)
        trees = [(float(w), _node(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]
        detector = Detector(trees)
        scored = test.filter("sure").select("kind", "n", (F.col("label") * F.col("n")).alias("right"), detector.probability(F.array(*inputs)).alias("p"))
        by_score = scored.groupBy("kind", "p").agg(F.sum("right").alias("right"), F.sum("n").alias("all")).orderBy("kind", F.col("p").desc()).collect()
        for k in range(len(KINDS)):
            mine = [r for r in by_score if r["kind"] == k]
            known, right, total = sum(r["right"] for r in mine), 0, 0
            for r in mine:
                if detector.thresholds[k] <= 1 and right >= RECALL * known:
                    break
                right, total = right + r["right"], total + r["all"]
                if right >= LEAST_KNOWN and right >= precision * total:
                    detector.thresholds[k] = r["p"]
        return detector
    finally:
        rows.unpersist()


def detect(docs: DataFrame, detector: Detector) -> DataFrame:
    """All columns of ``docs`` and ``base, spans``: arrays of ``kind, start, stop, found`` (code points, end exclusive).

    Columns of ``docs`` that have these two names are replaced.

    ``spans`` holds ``base`` and the candidates above their kind's threshold; of added spans that overlap, the likeliest stays (then
    the first). Null texts are empty and have no spans. Rows are looked at one by one, so repeated rows repeat their result.
    """
    own = [F.col(f"row_.`{c}`") for c in docs.columns if c not in ("base", "spans")]
    df = with_candidates(docs.select(F.struct("*").alias("row_"), F.col("text")))
    if not detector.trees or min(detector.thresholds) > 1:
        return df.select(*own, "base", F.col("base").alias("spans"))
    limit = F.array(*(F.lit(float(t)) for t in detector.thresholds))
    scorable = F.filter("candidates", lambda c: F.get(limit, c["kind"]) <= 1)
    described = F.transform(scorable, lambda c: F.struct(c.alias("c"), F.array(*_features(c, F.col("body_"))).alias("f")))
    scored = F.transform(described, lambda x: F.struct(x["c"].alias("c"), detector.probability(x["f"]).alias("p")))
    df = df.withColumn("scored_", F.filter(scored, lambda x: x["p"] >= F.get(limit, x["c"]["kind"])))

    def beaten(x: Column) -> Column:
        better = lambda y: (y["p"] > x["p"]) | ((y["p"] == x["p"]) & ((y["c"]["start"] < x["c"]["start"]) | ((y["c"]["start"] == x["c"]["start"])
                            & ((y["c"]["stop"] > x["c"]["stop"]) | ((y["c"]["stop"] == x["c"]["stop"]) & (y["c"]["kind"] < x["c"]["kind"]))))))
        return F.exists("scored_", lambda y: _overlaps(x["c"], y["c"]) & better(y))

    added = F.transform(F.filter("scored_", lambda x: ~beaten(x)), lambda x: x["c"])
    return df.select(*own, "base", _in_order(F.concat("base", added)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with ``<kind>`` in place of every span (of overlapping ones, the first names the kind). A null text stays null."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(apart, out).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
