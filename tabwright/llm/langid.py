"""Language identification by cross-parsing entropy.

A suffix automaton holds the labelled text of each language. A text is cut into phrases, each the longest match in that
automaton; the language that needs the fewest phrases, normalised by the size of its text, wins.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.tables import portions

#: The sample that a language is learned from: so many documents, and of all of them together so many bytes.
SAMPLE_DOCS = 64
SAMPLE_BYTES = 16_384
UNKNOWN = "und"
#: Texts that are parsed step by step together; the last, longest ones are parsed alone.
_LANES = 24
#: Set in a transition that ends a phrase.
_CUT = 1 << 30


_DIGITS = str.maketrans("", "", "0123456789")


def folded(text: str) -> bytes:
    """Lower case, white space as single blanks, digits left out."""
    return " ".join(text.lower().translate(_DIGITS).split()).encode()


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``data``; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in data:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


@dataclass
class Parser:
    """One language. ``table[state * width + class]`` is the next state times width, plus ``_CUT`` where a new phrase begins."""

    language: str
    bytes: int
    classes: bytes
    width: int
    table: np.ndarray

    @staticmethod
    def of(language: str, sample: bytes) -> Parser:
        step = suffix_automaton(sample)
        seen = sorted(set(sample))
        number = {c: k + 1 for k, c in enumerate(seen)}  # class 0: bytes that the sample lacks
        width = len(seen) + 1
        # Where no longer match exists, the phrase ends and the next begins with this byte; a byte never seen is a phrase itself.
        restart = np.full(width, _CUT, np.int32)
        for c, to in step[0].items():
            restart[number[c]] = to * width + _CUT
        table = np.tile(restart, (len(step), 1))
        for state, edges in enumerate(step):
            if state:
                for c, to in edges.items():
                    table[state, number[c]] = to * width
        return Parser(language, len(sample), bytes(number.get(c, 0) for c in range(256)), width, table.ravel())

    def phrases(self, texts: Sequence[bytes]) -> np.ndarray:
        """How many phrases each text is cut into."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        flat = np.frombuffer(b"".join(texts[k] for k in order).translate(self.classes), np.uint8)
        lengths = np.array([len(texts[k]) for k in order], np.int64)
        begin = np.cumsum(lengths) - lengths
        state, count = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        active, t = int((lengths > 0).sum()), 0
        shorter = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right") if len(order) else []
        while active > _LANES:
            at = state[:active] + flat[begin[:active] + t]
            went = self.table[at]
            cut = went >> 30
            count[:active] += cut
            state[:active] = went - (cut << 30)
            t += 1
            active = int(shorter[t]) if t < len(shorter) else 0
        step = self.table if not active else memoryview(self.table)
        for k in range(active):
            s, n = int(state[k]), 0
            for c in flat[begin[k] + t:begin[k] + lengths[k]].tobytes():
                s = step[s + c]
                if s >= _CUT:
                    s, n = s - _CUT, n + 1
            count[k] += n
        result = np.empty(len(order), np.int64)
        result[order] = count
        return result

    def entropy(self, phrases: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bits per byte: a phrase costs the logarithm of the places at which it may begin in the sample."""
        return phrases * math.log2(max(2, self.bytes)) / np.maximum(lengths, 1)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text is 2 modulo 4. A null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(True))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """The sample text of every language.

    Of each language's documents that are not held out and have a letter, the ``sample_docs`` with the smallest hashes are taken. They share
    ``sample_bytes``: each gives a stretch at a hashed place of its text, and what short documents leave goes to longer ones.
    Repeated texts count once per row. Only this bounded sample reaches the driver. A warning names languages whose stretches hold nothing to
    learn from.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    # Folding shortens texts (digits, white space), so more than the share is fetched.
    rows = rows.select("lang", F.xxhash64("doc_id", F.lit(4)).alias("hash"), _stretch(F.col("text"), F.xxhash64("doc_id", F.lit(5)), F.lit(4 * sample_bytes)).alias("excerpt"))
    first = Window.partitionBy("lang").orderBy("hash", "excerpt")
    sample = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= sample_docs)
    share = F.ceil(4 * sample_bytes / F.count(F.lit(1)).over(Window.partitionBy("lang"))).cast("int")
    sample = sample.select("lang", "place", _stretch(F.col("excerpt"), F.xxhash64("hash"), share).alias("excerpt")).orderBy("lang", "place").collect()
    texts: dict[str, list[bytes]] = {}
    for r in sample:
        texts.setdefault(r["lang"], []).append(folded(r["excerpt"]))
    samples = {k: b" ".join(_shared(v, sample_bytes)) for k, v in texts.items() if any(v)}
    if len(samples) < len(texts):
        warnings.warn(f"nothing to learn from in languages {sorted(set(texts) - set(samples))}", stacklevel=2)
    return samples


def _stretch(text: Column, hash: Column, length: Column) -> Column:
    """``length`` characters of a text from a place that the hash tells, or all of it."""
    return F.substr(text, (F.pmod(hash, F.greatest(F.length(text) - length, F.lit(0)) + 1) + 1).cast("int"), length)


def _shared(texts: list[bytes], total: int) -> list[bytes]:
    """Heads of the stretches that have ``total`` bytes together, as equal as their lengths allow."""
    cut, left = [b""] * len(texts), total
    for n, k in enumerate(sorted(range(len(texts)), key=lambda k: len(texts[k]))):
        cut[k] = texts[k][:left // (len(texts) - n)]
        left -= len(cut[k])
    return [t for t in cut if t]


#: A text that no learned language parses into phrases of so many bytes on average is in none of them. Bytes that a sample lacks
#: are phrases of one byte; the shortest clean texts, full of names and numbers, still reach 1.7.
LEAST_PHRASE = 1.25
#: A shorter folded text is too short to judge.
LEAST_BYTES = 8


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are in a learned language.

    Rejected are ``und`` texts and those that even the best language cuts into phrases shorter than ``LEAST_PHRASE`` bytes, as other
    scripts and noise are. Texts with a letter that fold to fewer than ``LEAST_BYTES`` bytes stay, whatever their phrases. Null and empty texts go, an
    empty table gives an empty one, repeated rows are judged alike, and columns may have any names. Where nothing could be learned, nothing is known to be foreign: all texts with a letter stay.
    """
    samples = learn(docs)
    if not samples:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    limit = {k: math.log2(max(2, len(v))) / LEAST_PHRASE for k, v in samples.items()}
    # The text travels once, inside the row.
    found = identify(docs.select(F.struct("*").alias("row_")), samples, carry=["row_"], text="row_.text")
    most = F.create_map(*(F.lit(x) for kv in limit.items() for x in kv))
    short = (F.col("lang_pred") != UNKNOWN) & (F.col("n_folded") < LEAST_BYTES)
    return found.filter(short | (F.col("bits") <= F.element_at(most, F.col("lang_pred")))).select("row_.*")


_parsers: dict[tuple, list[Parser]] = {}


def parsers(samples: dict[str, bytes]) -> list[Parser]:
    """Built once per process."""
    key = tuple(sorted(samples.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = [Parser.of(k, v) for k, v in key]
    return _parsers[key]


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:256]) or any(c.isalpha() for c in text)


def identify(docs: DataFrame, samples: dict[str, bytes], carry: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``carry`` columns, ``lang_pred`` (a learned language or ``und``), ``score``, ``bits`` and ``n_folded`` for every row of ``docs``.

    The column ``text`` may be ``row.field`` for a field of a carried struct.

    ``score`` is the probability, among the learned languages, that the entropies stand for: 0 for ``und``, 1 if one language only
    was learned. Texts that are null, empty or without a letter are ``und``, as is everything where nothing was learned; ties go to
    the first language by code point. ``bits`` is the winner's entropy in bits per byte, null for ``und``; ``n_folded`` counts the bytes
    that were parsed. Whole texts are parsed.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "lang_pred string", "score double", "bits double", "n_folded long"])
    row, _, leaf = text.partition(".")
    inside = bool(leaf) and row in carry

    def texts_of(batch: pa.RecordBatch) -> pa.Array:
        return batch.column(row).field(leaf).cast(pa.string()) if inside else batch.column("text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parsers(samples)
        for batch in portions(batches, texts_of, 4096, 1 << 22):
            texts = [folded(t) if t and has_letter(t) else b"" for t in texts_of(batch).to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            clear = (lengths > 0) & bool(known)
            names, score, bits = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if clear.any():
                rates = np.stack([p.entropy(p.phrases(texts), lengths) for p in known])
                best = rates.argmin(axis=0)
                least = rates.min(axis=0)
                # Shares of 2^-bits over a stretch of 8 bytes.
                share = 1 / np.exp2(-8 * (rates - least)).sum(axis=0)
                score = np.where(clear, share, 0.0)
                names = [known[b].language if c else UNKNOWN for b, c in zip(best, clear)]
                bits = [float(x) if c else None for x, c in zip(least, clear)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(names, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(bits, pa.float64()), pa.array(lengths, pa.int64())], [*carry, "lang_pred", "score", "bits", "n_folded"])

    given = [] if inside else [F.col(text).cast("string").alias("text_")]
    return docs.select(*carry, *given).mapInArrow(run, schema)
