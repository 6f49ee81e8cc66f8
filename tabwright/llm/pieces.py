"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Text is cut into units that no piece crosses (a run of blanks and what follows up to the next blank). Within a unit, neighbouring pieces merge
in order of score, the leftmost first; dropout skips a candidate merge by a keyed hash of its place, so a segmentation
depends on nothing but seed, variant and unit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.shingles import mixed
from tabwright.llm.tables import portions

#: Share of candidate merges that are skipped, and how many segmentations of a unit documents choose from.
DROPOUT = 0.1
VARIANTS = 4
#: Units longer than this are merged one by one with an agenda, shorter ones many at a time.
LONG_UNIT = 48
#: Distinct units that a task remembers.
REMEMBERED = 100_000
#: Long texts are taken in sections of about so many characters.
SECTION = 1 << 18

_SPACE = "▁"
_UNIT = re.compile(r"\n| *[^ \n]+| +")
_BLANKS_BEGIN = re.compile(r"(?<! ) ")
_NONE = np.int32(-1)


class Pieces:
    """Vocabulary, merges and byte pieces of a SentencePiece BPE model file."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_unknown(i) or model.is_control(i) or model.is_unused(i) for i in range(size)]
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback, so texts could not be decoded losslessly")
        byte_ids = set(self.byte.values())
        self.id = {t: i for i, t in enumerate(self.text) if not special[i] and i not in byte_ids}
        if any(_SPACE in t.lstrip(_SPACE) or "\n" in t for t in self.id):
            raise ValueError("the model has pieces across words")
        # A literal U+2581 must not decode to a blank, so it has no piece here and goes by its bytes.
        self.of_code = np.full(0x110000, _NONE, np.int32)
        for t, i in self.id.items():
            if len(t) == 1:
                self.of_code[ord(t)] = i
        self.of_code[[ord(" "), ord(_SPACE)]] = self.id.get(_SPACE, _NONE), _NONE
        self.score = np.array([model.get_score(i) for i in range(size)], np.float32)
        # What each piece decodes to; bytes of one character may be split over pieces.
        raw = [b"" if special[i] else bytes([int(t[3:5], 16)]) if i in byte_ids else t.replace(_SPACE, " ").encode() for i, t in enumerate(self.text)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([*map(len, raw), 0], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        pairs = [(self.id[t[:k]], self.id[t[k:]], i) for t, i in self.id.items() for k in range(1, len(t)) if t[:k] in self.id and t[k:] in self.id]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] * size + table[:, 1]
        order = np.argsort(keys)
        self.size, self.merge_keys, self.merge_to = size, keys[order], table[order, 2].astype(np.int32)
        # Higher scores first; equal scores count as one, so that the leftmost wins.
        self.priority = np.unique(-self.score, return_inverse=True)[1].astype(np.int32)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two pieces merge to, or -1."""
        if not len(self.merge_keys):
            return np.full(len(left), _NONE)
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
        return np.where((self.merge_keys[at] == keys) & (left >= 0) & (right >= 0), self.merge_to[at], _NONE)

    def symbols(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """One piece per character (blanks in the model's form), or its bytes: all symbols, and how many each unit has."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.of_code[codes]
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        missing = np.flatnonzero(symbols < 0)
        if not len(missing):
            return symbols, lengths
        as_bytes = [[self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in codes[missing].tolist()]
        widths = np.ones(len(codes), np.int64)
        widths[missing] = [len(b) for b in as_bytes]
        starts = np.cumsum(widths) - widths
        symbols = np.repeat(symbols, widths)
        for k, b in zip(starts[missing].tolist(), as_bytes):
            symbols[k:k + len(b)] = b
        owner = np.repeat(np.arange(len(units)), lengths)
        return symbols, np.bincount(owner, widths, len(units)).astype(np.int64)


@cache
def load(model_file: str) -> Pieces:
    return Pieces(model_file)


def unit_keys(symbols: np.ndarray, lengths: np.ndarray, variant: int, seed: int) -> np.ndarray:
    """A hash of every unit's symbols, the variant and the seed."""
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(symbols)) - np.repeat(starts, lengths)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mixed((symbols.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1)), out=total[1:])
    own = np.array([(seed * 1_000_003 + variant + 1) & (2**64 - 1)], np.uint64)
    return mixed((total[starts + lengths] - total[starts]) ^ mixed(own))


def skipped(keys: np.ndarray, starts: np.ndarray, middles: np.ndarray, ends: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the merge of ``start .. middle`` and ``middle .. end`` (symbols of the unit) is skipped."""
    place = (starts.astype(np.uint64) << np.uint64(42)) ^ (middles.astype(np.uint64) << np.uint64(21)) ^ ends.astype(np.uint64)
    return (mixed(keys ^ mixed(place)) >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53


def agenda_merge(pieces: Pieces, symbols: Sequence[int], key: int, dropout: float) -> list[int]:
    """Merge one unit with an agenda of candidates."""
    n = len(symbols)
    piece, end, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def push(lefts: list[int]) -> None:
        lefts = [k for k in lefts if k >= 0 and end[k] < n]
        if not lefts:
            return
        right = [end[k] for k in lefts]
        to = pieces.merge(np.array([piece[k] for k in lefts]), np.array([piece[k] for k in right]))
        last = [end[k] for k in right]
        skip = skipped(np.full(len(lefts), key, np.uint64), np.array(lefts), np.array(right), np.array(last), dropout)
        for k, r, e, t, s in zip(lefts, right, last, to.tolist(), skip.tolist()):
            if t >= 0 and not s:
                heapq.heappush(agenda, (int(pieces.priority[t]), k, r, e, t))

    push(list(range(n - 1)))
    while agenda:
        _, k, r, e, t = heapq.heappop(agenda)
        if piece[k] < 0 or piece[r] < 0 or end[k] != r or end[r] != e:
            continue  # one of the two has merged otherwise
        piece[k], end[k], piece[r] = t, e, -1
        if e < n:
            before[e] = k
        push([before[k], k])
    return [p for p in piece if p >= 0]


def merge_together(pieces: Pieces, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for many units of similar length at once: every round merges the best candidate of each unit.

    Returns all pieces, and how many each unit has.
    """
    n, longest = len(lengths), int(lengths.max())
    symbol = np.full((n, longest + 1), _NONE, np.int32)
    symbol[np.arange(longest + 1) < lengths[:, None]] = symbols
    end = np.tile(np.arange(1, longest + 2), (n, 1))
    before = np.tile(np.arange(-1, longest), (n, 1))
    worst = np.iinfo(np.int32).max
    target = np.full((n, longest + 1), _NONE, np.int32)
    rank = np.full((n, longest + 1), worst, np.int32)

    def rate(rows: np.ndarray, lefts: np.ndarray) -> None:
        right = end[rows, lefts]
        fine = right < lengths[rows]
        rank[rows, lefts] = worst
        rows, lefts, right = rows[fine], lefts[fine], right[fine]
        to = pieces.merge(symbol[rows, lefts], symbol[rows, right])
        to[skipped(keys[rows], lefts, right, end[rows, right], dropout)] = _NONE
        found = to >= 0
        rows, lefts, to = rows[found], lefts[found], to[found]
        target[rows, lefts], rank[rows, lefts] = to, pieces.priority[to]

    rows, lefts = np.nonzero(np.arange(longest) < (lengths - 1)[:, None])
    rate(rows, lefts)
    live = np.arange(n)
    while len(live):
        left = rank[live].argmin(axis=1)  # the first of equals
        go = rank[live, left] < worst
        live, left = live[go], left[go]
        if not len(live):
            break
        right = end[live, left]
        after = end[live, right]
        symbol[live, left] = target[live, left]
        symbol[live, right], rank[live, right] = _NONE, worst
        end[live, left] = after
        inner = after < lengths[live]
        before[live[inner], after[inner]] = left[inner]
        rate(live, left)
        prior = before[live, left]
        some = prior >= 0
        rate(live[some], prior[some])
    return symbol[symbol >= 0], (symbol >= 0).sum(axis=1)


class Encoder:
    """Encodes texts of one variant, remembering the units it has met."""

    def __init__(self, pieces: Pieces, variant: int, seed: int, dropout: float) -> None:
        self.pieces, self.variant, self.seed, self.dropout = pieces, variant, seed, dropout
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, units: list[str]) -> None:
        units = sorted(units, key=len)
        symbols, lengths = self.pieces.symbols(units)
        ends = np.cumsum(lengths)
        keys = unit_keys(symbols, lengths, self.variant, self.seed)
        found, sizes, start = [], [], 0
        while start < len(units):
            # Lengths ascend but for characters that go by bytes; a group is a stretch of similar ones.
            limit = max(int(lengths[start]) + 1, int(lengths[start]) * 5 // 4)
            stop = start + 1
            if lengths[start] <= LONG_UNIT:
                above = np.flatnonzero(lengths[start:start + 16384] > limit)
                stop = start + (int(above[0]) if len(above) else min(16384, len(units) - start))
            own = symbols[ends[start] - lengths[start]:ends[stop - 1]]
            if lengths[start] > LONG_UNIT:
                ids = np.array(agenda_merge(self.pieces, own.tolist(), int(keys[start]), self.dropout), np.int32)
                size = np.array([len(ids)])
            else:
                ids, size = merge_together(self.pieces, own, lengths[start:stop], keys[start:stop], self.dropout)
            found.append(ids)
            sizes.append(size)
            start = stop
        first = len(self.place)
        self.place.update(zip(units, range(first, first + len(units))))
        self.ids = np.concatenate([self.ids, *found])
        self.ends = np.concatenate([self.ends, np.cumsum(np.concatenate(sizes)) + self.ends[-1]])

    def _sections(self, sections: list[str]) -> list[np.ndarray]:
        units = [_UNIT.findall(x) for x in sections]
        if len(self.place) > REMEMBERED:
            self._forget()
        if new := {u for x in units for u in x if u not in self.place}:
            self._learn(sorted(new))
        result = []
        for x in units:
            at = np.fromiter(map(self.place.__getitem__, x), np.int64, len(x))
            begin, size = self.ends[at], self.ends[at + 1] - self.ends[at]
            filled = np.cumsum(size)
            result.append(self.ids[np.arange(filled[-1]) + np.repeat(begin - (filled - size), size)])
        return result

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        owners, sections, held = [], [], 0
        for k, text in enumerate(texts):
            text, at = " " + text if text else "", 0
            while at < len(text):
                cut = _BLANKS_BEGIN.search(text, at + SECTION) if len(text) - at > 2 * SECTION else None
                stop = cut.start() if cut else len(text)
                owners.append(k)
                sections.append(text[at:stop])
                held, at = held + stop - at, stop
                if held >= 4 * SECTION:
                    for o, ids in zip(owners, self._sections(sections)):
                        parts[o].append(ids)
                    owners, sections, held = [], [], 0
        for o, ids in zip(owners, self._sections(sections)):
            parts[o].append(ids)
        return [np.concatenate(x) if x else np.empty(0, np.int32) for x in parts]


def decode(pieces: Pieces, ids: Sequence[int]) -> str:
    """The text that was encoded; ids outside the vocabulary and control pieces stand for nothing."""
    return decode_all(pieces, np.asarray(ids, np.int64), np.array([len(ids)]))[0]


def decode_all(pieces: Pieces, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """``decode`` of many texts whose ids lie one after the other, up to ``ends``."""
    ids = np.where((ids >= 0) & (ids < pieces.size), ids, pieces.size)  # one past the end: nothing
    size = pieces.raw_size[ids]
    filled = np.concatenate([[0], np.cumsum(size)])
    raw = pieces.raw[np.arange(filled[-1]) + np.repeat(pieces.raw_start[ids] - filled[:-1], size)].tobytes()
    cuts = filled[np.concatenate([[0], ends])]
    parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    return [(p[1:] if p[:1] == b" " else p).decode("utf-8", "replace") for p in parts]


_encoders: dict[tuple, Encoder] = {}


def encode(docs: DataFrame, model_file: str, dropout: float = DROPOUT, variants: int = VARIANTS, seed: int = 0, carry: Sequence[str] = ("doc_id",),
           copy: str | None = None) -> DataFrame:
    """``carry`` columns and ``ids array<int>`` of every row's whole text.

    A document's variant is a hash of its doc_id, or of its text if that is null, and the next ones for further copies, numbered from 0 by the
    column ``copy``: with ``dropout`` above 0, documents choose among ``variants`` segmentations of a unit and up to ``variants`` copies of
    one differ. A new ``seed`` gives new ones; the same seed always gives the same. With ``dropout`` 0 the ids are the model's own. A null text has null
    ids, an empty one none; a very long one is cut nowhere. Rows that repeat an id and a text get the same ids unless ``copy`` tells them apart; an
    empty table gives an empty one. A carried column must not be named ``ids``, others may have any names. Characters
    without a piece, and a literal U+2581, become byte pieces, so decoding is lossless.
    """
    if "ids" in carry:
        raise ValueError("rename the carried column 'ids'")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    known = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    first = F.pmod(F.xxhash64(known, F.lit(seed)), F.lit(variants))
    chosen = F.pmod(first + (F.coalesce(F.col(copy), F.lit(0)) if copy else F.lit(0)), F.lit(variants)).cast("int").alias("variant_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for batch in portions(batches, "text_"):
            texts, variant = batch.column("text_").to_pylist(), np.asarray(batch.column("variant_"))
            parts: list = [np.empty(0, np.int32)] * len(texts)
            for v in np.unique(variant).tolist():
                key = (model_file, v, seed, dropout)
                if key not in _encoders:
                    _encoders[key] = Encoder(pieces, v, seed, dropout)
                own = np.flatnonzero(variant == v)
                for k, ids in zip(own, _encoders[key].encode([texts[k] or "" for k in own])):
                    parts[k] = ids
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
            missing = pa.array([t is None for t in texts], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=missing)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), lists], [*carry, "ids"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "ids array<int>"])
    return docs.select(*carry, F.col("text").cast("string").alias("text_"), chosen).mapInArrow(run, schema)


def decoded(encoded: DataFrame, model_file: str) -> DataFrame:
    """All columns and ``text``, decoded from ``ids``; null ids give a null text."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lists = batch.column("ids")
                filled = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))
                texts = decode_all(pieces, np.asarray(lists.flatten(), np.int64), filled)
                found = pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, schema)
