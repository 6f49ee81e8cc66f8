"""How far the words of a source lie from those of its language: an audit of sources by iceberg prefix refinement.

A language keeps the terms that occur in at least ``LEAST_DOCUMENTS`` of its documents. They are found by prefixes of their UTF-8 bytes:
a prefix that fewer documents hold cannot lead to a kept term, so it is discarded with all its extensions before these are
counted; the rest is extended to ``GROWTH`` times its length, until complete terms remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.shingles import distinct
from tabwright.llm.tables import portions, text_bytes
from tabwright.storage import written

#: A kept term occurs in at least so many documents of its language.
LEAST_DOCUMENTS = 3
#: Bytes of the shortest prefixes, by which the terms are also dealt over tasks.
FIRST_PREFIX = 8
#: Each level has prefixes so many times as long as the one before.
GROWTH = 4
#: Text, in bytes, whose terms a task sums at a time.
PART_BYTES = 10 << 20
#: Probabilities are counted in parts of so many.
PARTS = 1_000_000_000

#: Terms are runs of A-Z, a-z and all that is not ASCII; only A-Z is lower-cased.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of every occurrence of a term: number of its text and of the term; and the terms."""
    data = b" ".join(texts).translate(_TERM_BYTES)
    flat = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(flat) + 2, np.int8)
    inside[1:-1] = flat != 32
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    offsets = np.cumsum(np.append(0, ends - starts))
    letters = np.ascontiguousarray(flat[inside[1:-1].astype(bool)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    document = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    return document, np.asarray(coded.indices, np.int64), coded.dictionary.cast(pa.binary())


def _coded(values: list) -> tuple[np.ndarray, list]:
    numbers: dict = {}
    return np.array([numbers.setdefault(v, len(numbers)) for v in values], np.int64), list(numbers)


def _lists(rows: np.ndarray, n: int) -> pa.Array:
    """Borders of lists, from the sorted number of the list of every element."""
    return pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))


def _summed_part(langs: list[str], sources: list[str], texts: list[bytes], first: int) -> pa.RecordBatch:
    document, term, terms = _terms(texts)
    lang, lang_names = _coded(langs)
    pair, pairs = _coded(list(zip(langs, sources)))
    kinds = max(len(terms), 1)
    once = distinct(document * kinds + term)
    once_document, once_term = once // kinds, once % kinds
    rows, documents = np.unique(lang[once_document] * kinds + once_term, return_counts=True)
    row_lang, row_term = rows // kinds, rows % kinds

    # Documents with a prefix stand with the first of its terms, so that sums over terms count each of them once.
    lengths = np.asarray(pc.binary_length(terms), np.int64)
    places, depths, found = [], [], []
    size, depth = first, 0
    while (lengths >= size).any():
        coded = pc.binary_slice(terms, 0, size).dictionary_encode()
        prefix, n = np.asarray(coded.indices, np.int64), len(coded.dictionary)
        long = lengths >= size
        of_rows = np.flatnonzero(long[row_term])
        keys, holder = np.unique(row_lang[of_rows] * n + prefix[row_term[of_rows]], return_index=True)
        held = long[once_term]
        holds = distinct(once_document[held] * n + prefix[once_term[held]])
        _, counts = np.unique(lang[holds // n] * n + holds % n, return_counts=True)
        value = np.zeros(len(rows), np.int64)
        value[of_rows[holder]] = counts
        places.append(of_rows)
        depths.append(np.full(len(of_rows), depth))
        found.append(value[of_rows])
        size, depth = GROWTH * size, depth + 1
    place, depth_of, value = (np.concatenate([np.empty(0, np.int64), *part]) for part in (places, depths, found))
    order = np.lexsort((depth_of, place))
    prefix_documents = pa.ListArray.from_arrays(_lists(place[order], len(rows)), pa.array(value[order]))

    own, counts = np.unique(pair[document] * kinds + term, return_counts=True)
    lang_of_pair = np.array([lang_names.index(name) for name, _ in pairs], np.int64)
    row_of_own = np.searchsorted(rows, lang_of_pair[own // kinds] * kinds + own % kinds)
    order = np.argsort(row_of_own, kind="stable")
    names = pa.array([source for _, source in pairs]).take(pa.array(own[order] // kinds))
    by_source = pa.ListArray.from_arrays(_lists(row_of_own[order], len(rows)), pa.StructArray.from_arrays([names, pa.array(counts[order])], ["source", "n"]))
    return pa.RecordBatch.from_arrays([pa.array(lang_names, pa.string()).take(pa.array(row_lang)), terms.take(pa.array(row_term)), pa.array(documents),
                                       prefix_documents, by_source], ["lang", "term", "documents", "prefix_documents", "sources"])


def _summed(first: int):
    """Terms of the documents of a part, by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for piece in portions(batches, "text"):
            texts = text_bytes(piece.column("text"))
            for column, values in zip(held, (piece.column("lang").to_pylist(), piece.column("source").to_pylist(), texts)):
                column.extend(values)
            size += sum(map(len, texts))
            if size >= PART_BYTES:
                whole = _summed_part(*held, first)
                held, size = ([], [], []), 0
                yield from portions(iter([whole]), "term", 20_000)
        if held[0]:
            yield from portions(iter([_summed_part(*held, first)]), "term", 20_000)

    return run


def refined(summed: DataFrame, least: int, longest: int, first: int = FIRST_PREFIX) -> DataFrame:
    """The rows of ``summed`` whose term occurs in at least ``least`` documents of its ``lang``, with ``head``, its shortest prefix.

    ``summed`` has a row per ``lang``, binary ``term`` (of at most ``longest`` bytes, without the byte 0) and part of the documents:
    ``documents``, the number of those with the term, and ``prefix_documents``, one number for every size ``first``, ``GROWTH * first``, ... up to the length of the
    term: of the rows of a part that share the lang and the prefix of that size, one holds the number of documents with it, the
    others 0. Prefixes are counted level by level, and the rows of those in fewer than ``least`` documents go; a term shorter than the
    size of a level is complete there, with its own documents. All levels work on one shuffle by lang and shortest prefix.
    """
    marked = F.concat("term", F.lit(b"\x00"))
    live = summed.withColumn("head", F.substring(marked, 1, first)).repartition("head", "lang")
    columns, size, depth = live.columns, first, 0
    while True:
        live = live.withColumn("prefix_", F.substring(marked, 1, size))
        documents = F.when(F.octet_length("term") < size, F.col("documents")).otherwise(F.get("prefix_documents", F.lit(depth)))
        found = F.sum(documents).over(Window.partitionBy("head", "lang", *([] if size == first else ["prefix_"])))
        live = live.withColumn("found_", found).filter(F.col("found_") >= least).select(columns)
        if size > longest:
            return live
        size, depth = GROWTH * size, depth + 1


def _probability(n: str, total: str, kinds: str) -> str:
    """``1 + floor(PARTS * (n + 1) / (total + kinds))``, exact for any count."""
    return f"(1 + (CAST({PARTS} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(19, 0))) div CAST({total} + {kinds} AS DECIMAL(19, 0)))"


def _gap(p: str, q: str) -> str:
    """``floor((p - q) ** 2 / q)``; probabilities are below 2 ** 31, so a long holds all of it."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, source, term, n``: occurrences of every kept term of a language in those of its sources that have it, written.

    Null text, lang and source count as ''. Every row is a document, repeated rows and ids too.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    schema = "lang string, term binary, documents long, prefix_documents array<long>, sources array<struct<source:string,n:bigint>>"
    summed = written(docs.select(*filled).mapInArrow(_summed(FIRST_PREFIX), schema), "audit-terms")
    longest = summed.agg(F.max(F.octet_length("term"))).first()[0] or 0
    kept = refined(summed, least, longest).select("lang", "head", "term", F.inline("sources"))
    # Grouping by the shortest prefix too needs no further shuffle.
    kept = kept.groupBy("head", "lang", "term", "source").agg(F.sum("n").alias("n"))
    return written(kept.select("lang", "source", F.col("term").cast("string").alias("term"), "n"), "audit-kept")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: how the sources of a language differ from each other and from the language.

    Every (lang, source) that occurs, and every lang, gives each of the V kept terms of the lang
    ``p = 1 + floor(10 ** 9 * (n + 1) / (N + V))``, n its occurrences there and N their sum over the kept terms. Against q,
    ``f = floor((p - q) ** 2 / q)``. Part ``pair``: item is each other source of the lang, value the sum of f over all kept terms against its q
    (0 without kept terms), all ranks. Part ``term``: item is each kept term that the source has, with p above the lang's q, value
    f, ranks to ``top``. Ranks go by value, descending, then by the item's UTF-8 bytes.

    Null text, lang and source count as ''; every row is a document, repeated rows too; doc_id and other columns are not read. A
    text without terms still makes its (lang, source) occur. An empty table gives an empty one. Texts of any length are read whole.

    Terms are summed per part of a task, then shuffled once by lang and first bytes. Sums over pairs meet only where both sources
    have a term; terms that one or none has come from numbers of terms per count.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*names).distinct()
    kept = kept_terms(docs, least)
    of_lang = written(kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "audit-lang")
    langs = of_lang.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kinds"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_kinds"))
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["lang_total", "kinds", "total", "own_kinds"])
    # Probability of a term that the source does not have.
    absent = F.when(F.col("kinds") > 0, F.expr(_probability("0L", "total", "kinds"))).alias("absent")
    groups = written(groups.select("*", absent), "audit-groups")
    facts = groups.select("lang", "source", "total", "kinds", "absent", "lang_total", "own_kinds")
    counted = written(kept.join(facts, ["lang", "source"]).select("lang", "source", "term", "n", "lang_total", "kinds", "absent", F.expr(_probability("n", "total", "kinds")).alias("p")), "audit-counted")

    # Pairs of sources: all terms as if the other had none of them, and what differs for the terms that both have.
    own, other = facts.select(*[F.col(c).alias(f"g_{c}") for c in facts.columns]), facts.select(*[F.col(c).alias(f"s_{c}") for c in facts.columns])
    pairs = own.join(other, (F.col("g_lang") == F.col("s_lang")) & (F.col("g_source") != F.col("s_source")))
    pairs = pairs.select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), F.col("s_source").alias("item"), F.col("g_absent").alias("p0"),
                         F.col("s_absent").alias("q0"), (F.col("g_kinds") - F.col("g_own_kinds") - F.col("s_own_kinds")).alias("rest"))
    levels = written(counted.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms")), "audit-levels")
    above = levels.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.expr(f"terms * {_gap('p', 'q0')}")).alias("above"))
    flipped = levels.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "terms")
    below = flipped.join(pairs, ["lang", "item"]).groupBy("lang", "source", "item").agg(F.sum(F.expr(f"terms * {_gap('p0', 'q')}")).alias("below"))
    mine = counted.select("lang", "term", "source", "p", F.col("absent").alias("p0"))
    theirs = counted.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("absent").alias("q0"))
    both = mine.join(theirs.hint("merge"), ["lang", "term"]).filter("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.expr(f"{_gap('p', 'q')} - {_gap('p', 'q0')} - {_gap('p0', 'q')} + {_gap('p0', 'q0')}")).alias("both"))
    key = ["lang", "source", "item"]
    value = F.coalesce(F.col("rest") * F.expr(_gap("p0", "q0")), F.lit(0))
    for part in ("above", "below", "both"):
        value = value + F.coalesce(part, F.lit(0))
    of_pairs = pairs.join(above, key, "left").join(below, key, "left").join(both, key, "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    # Terms that a source has more often than its language.
    of_terms = counted.join(of_lang.hint("merge"), ["lang", "term"]).withColumn("q", F.expr(_probability("lang_n", "lang_total", "kinds"))).filter("p > q")
    of_terms = of_terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = [of_pairs.withColumn("rank", F.row_number().over(best)), of_terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1])
