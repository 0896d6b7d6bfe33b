"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

SPACE = "▁"
#: Stands for a literal U+2581 while a text is cut into units; no valid text holds it.
LITERAL = "\udc81"
DROPOUT = 0.1
#: The hash of a document and a place in it has this many values; so its merges are skipped apart from those of all other places.
VARIANTS = 2**62
CHUNK_CHARS = 1_000_000
CACHED_UNITS = 300_000
PLACES_AT_ONCE = 50_000
LONG_UNIT = 96
NONE = np.int64(2**62)
_LOW = np.int64(2**32 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((start.astype(np.uint64) << np.uint64(42)) ^ (mid.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64))


def _key(unit_hash: np.ndarray, variant: np.ndarray, seed: int) -> np.ndarray:
    return _mix(unit_hash.astype(np.uint64) + variant.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _kept(key: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
    return (_mix(key ^ place) >> np.uint64(11)) >= np.uint64(dropout * 2**53)


def keep_merge(unit_hash: np.ndarray, variant: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, seed: int, dropout: float) -> np.ndarray:
    """Whether the candidate that joins start..mid to mid..end of a unit is kept: a hash keyed by ``seed`` decides."""
    return _kept(_key(unit_hash, variant, seed), _place(start, mid, end), dropout)


_SLOT_BITS = 19
_SLOT_MASK = (1 << _SLOT_BITS) - 1


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values in an open-addressed table, -1 where a slot is free."""
    if 2 * len(keys) > _SLOT_MASK:
        raise ValueError("too many merges for the table")
    slots, held = np.full(_SLOT_MASK + 1, -1, np.int64), np.zeros(_SLOT_MASK + 1, np.int32)
    for key, value, at in zip(keys.tolist(), values.tolist(), _slot(keys).tolist()):
        while slots[at] >= 0:
            at = (at + 1) & _SLOT_MASK
        slots[at], held[at] = key, value
    return slots, held


def unit_name(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each unit in a row of code points, the units beginning at ``first``."""
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
    mixed = _mix(codes.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
    return np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)


class Pieces:
    """A merge-type SentencePiece model: its pieces, merges and their order."""

    def __init__(self, proto: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(size)]
        self.size = size
        self.normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ids = {text[i]: i for i in self.normal}
        if any(SPACE in piece.lstrip(SPACE) for piece in ids):
            raise ValueError("a piece with a space after other characters: words cannot be encoded apart")
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in self.normal}, reverse=True))}
        self.rank = np.zeros(size, np.int64)
        for i in self.normal:
            self.rank[i] = order[model.get_score(i)]
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.merge = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        keys = np.array([a * size + b for a, b in self.merge], np.int64)
        self.slots, self.merged = _hash_table(keys, np.array(list(self.merge.values()), np.int32))
        self.byte = {int(text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.raw = [b""] * size
        for i in self.normal:
            self.raw[i] = text[i].replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        self.unknown = model.unk_id()
        if len(self.byte) < 256:
            raise ValueError("without byte pieces a text with unknown characters cannot be decoded")

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that joins two pieces, -1 where there is none."""
        found = np.full(len(left), -1, np.int32)
        rows = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[rows].astype(np.int64) * self.size + right[rows]
        slot = _slot(key)
        while len(rows):
            there = self.slots[slot]
            hit = there == key
            found[rows[hit]] = self.merged[slot[hit]]
            on = ~hit & (there >= 0)
            rows, key, slot = rows[on], key[on], (slot[on] + 1) & _SLOT_MASK
        return found

    def spell(self, char: str) -> list[int]:
        """The bytes of a character that is no piece."""
        return [self.byte[b] for b in char.replace(LITERAL, SPACE).encode()]

    def agenda(self, unit: str, variant: int, seed: int, dropout: float) -> list[int]:
        """One unit with an agenda of candidates: best score first, then leftmost; a skipped candidate never comes back."""
        sym = [int(self.char[ord(c)]) for c in unit]
        n = len(sym)
        start, end = list(range(n)), [i + 1 for i in range(n)]
        before, after = [i - 1 for i in range(n)], [i + 1 for i in range(n)]
        name = unit_name(np.array([ord(c) for c in unit], np.uint32), np.array([0]))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i < 0 or j >= n or (sym[i], sym[j]) not in self.merge:
                return
            place = (np.array([x], np.uint64) for x in (start[i], start[j], end[j]))
            if not dropout or keep_merge(name, np.array([variant], np.uint64), *place, seed, dropout)[0]:
                heapq.heappush(heap, (int(self.rank[self.merge[sym[i], sym[j]]]), start[i], i, start[j], end[j]))

        alive = [True] * n
        for i in range(n):
            offer(i)
        while heap:
            _, _, i, mid, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[i] != mid or end[j] != stop:
                continue
            sym[i], end[i], after[i], alive[j] = self.merge[sym[i], sym[j]], end[j], after[j], False
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for i in range(n) if alive[i] for x in (self.spell(unit[start[i]]) if sym[i] < 0 else [sym[i]])]

    def segment(self, units: list[str], variants: np.ndarray, seed: int, dropout: float, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The agenda for many units at once, one merge of each unit in a round: all ids in a row, and their number by unit.
        The unit and the hashed place of every merge made are added to ``merges``."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(sizes) - sizes
        names = unit_name(codes, first)
        row = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        start = (np.arange(len(codes)) - first[row]).astype(np.int32)
        end = start + 1
        sym = self.char[codes]
        code = codes.copy()
        cand = np.full(len(sym), NONE)
        joined = np.full(len(sym), -1, np.int32)

        def offer(i: np.ndarray) -> None:
            i = i[(i >= 0) & (i < len(sym) - 1)]
            found = self.lookup(sym[i], sym[i + 1])
            ok = (found >= 0) & (row[i] == row[i + 1])
            i, found = i[ok], found[ok]
            if dropout:
                ok = keep_merge(names[row[i]], variants[row[i]], start[i], start[i + 1], end[i + 1], seed, dropout)
                i, found = i[ok], found[ok]
            joined[i], cand[i] = found, self.rank[found]

        offer(np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(np.where(cand < NONE, (cand << np.int64(32)) | np.arange(len(sym)), NONE), head)
            open_ = best < NONE
            counts = np.diff(np.r_[head, len(sym)])
            live = np.repeat(open_, counts)
            if not live.all():
                done.append((row[~live], sym[~live], code[~live]))
            i = best[open_] & _LOW
            if merges is not None:
                merges.append((row[i], _place(start[i], start[i + 1], end[i + 1])))
            sym[i], end[i] = joined[i], end[i + 1]
            cand[i] = NONE
            cand[i[i > 0] - 1] = NONE
            keep = live
            keep[i + 1] = False
            at = (np.cumsum(keep) - 1)[i]
            sym, start, end, row, cand, joined, code = (x[keep] for x in (sym, start, end, row, cand, joined, code))
            offer(at)
            before = at - 1
            before = before[before >= 0]
            offer(before[row[before] == row[before + 1]])
        row, sym, code = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        back = np.argsort(row, kind="stable")
        row, sym, code = row[back], sym[back].astype(np.int32), code[back]
        odd = np.flatnonzero(sym < 0)
        if len(odd):
            width = np.ones(len(sym), np.int64)
            spelt = [self.spell(chr(c)) for c in code[odd]]
            width[odd] = [len(s) for s in spelt]
            sym, row = np.repeat(sym, width), np.repeat(row, width)
            sym[sym < 0] = [x for s in spelt for x in s]
        return sym, np.bincount(row, minlength=len(units))


@lru_cache(maxsize=2)
def load(proto: bytes) -> Pieces:
    return Pieces(proto)


def units_of(text: str) -> list[str]:
    """The text with spaces as U+2581 and one in front, cut before each run of them; no piece spans a cut."""
    if not text:
        return []
    marked = text.replace(SPACE, LITERAL)
    parts = marked.split(" ")
    if "" not in parts:
        return [SPACE + p for p in parts]
    units, run = [], ""
    for part in parts:
        run += SPACE
        if part:
            units.append(run + part)
            run = ""
    return units + [run] if run else units


class Encoder:
    """Encodes texts, and keeps the plain segmentations of the units seen, with the merges that made them, up to a bound.

    A unit at a place where none of these merges is skipped takes the plain segmentation: a candidate that the agenda never came to
    changes nothing by being skipped. At all other places the unit is segmented anew.
    """

    def __init__(self, pieces: Pieces, seed: int, dropout: float, variants: int):
        self.pieces, self.seed, self.dropout, self.variants = pieces, seed, dropout, variants
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.hashes = np.zeros(0, np.uint64)
        self.ids, self.places = Rows(np.int32), Rows(np.uint64)

    def _variants(self, doc: int, n: int) -> np.ndarray:
        """The hash of each place of a document."""
        own = _mix(np.array([doc & (2**64 - 1)], np.uint64) ^ np.uint64(self.seed))
        return _mix(own + np.arange(n, dtype=np.uint64)) % np.uint64(self.variants)

    def _segment(self, units: list[str], variants: np.ndarray, dropout: float, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their number by unit; long units go through the plain agenda one by one, unless their merges are asked for."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        long = np.flatnonzero(sizes > LONG_UNIT)
        if not len(long) or merges is not None:
            return self.pieces.segment(units, variants, self.seed, dropout, merges)
        short = np.flatnonzero(sizes <= LONG_UNIT)
        ids, widths = self.pieces.segment([units[i] for i in short], variants[short], self.seed, dropout)
        more, wide = _joined([self.pieces.agenda(units[i], int(variants[i]), self.seed, dropout) for i in long])
        ids, widths, order = np.concatenate([ids, more]), np.concatenate([widths, wide]), np.argsort(np.concatenate([short, long]))
        return _take(ids, np.cumsum(widths) - widths, widths, order), widths[order]

    def _learn(self, units: list[str]) -> None:
        """Plain segmentations of new units. Long units have no merges here: at a place they are always segmented."""
        self.names += units
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.hashes = np.concatenate([self.hashes, unit_name(codes, np.cumsum(sizes) - sizes)])
        merges: list[tuple[np.ndarray, np.ndarray]] | None = [] if self.dropout else None
        rows = np.flatnonzero((sizes <= LONG_UNIT) | (not self.dropout))
        ids, widths = self._segment([units[i] for i in rows], np.zeros(len(rows), np.uint64), 0.0, merges)
        self.ids.add(ids, np.bincount(rows, weights=widths, minlength=len(units)).astype(np.int64))
        if self.dropout:
            row, place = (np.concatenate([m[k] for m in merges]) if merges else np.zeros(0, np.uint64) for k in (0, 1))
            self.places.add(place[np.argsort(row, kind="stable")], np.bincount(rows[row], minlength=len(units)))

    def encode(self, docs: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number by text."""
        if len(self.index) > CACHED_UNITS:
            self.clear()
        split = [units_of(t) for t in texts]
        units = [u for part in split for u in part]
        new = list(set(units).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.names), len(self.names) + len(new))))
            self._learn(new)
        uid = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        first, width = self.ids.first[uid], self.ids.width[uid].astype(np.int64)
        ids = self.ids.flat
        if self.dropout and len(units):
            variants = np.concatenate([self._variants(d, len(part)) for d, part in zip(docs, split)])
            anew = np.fromiter((len(u) > LONG_UNIT for u in units), bool, len(units))
            key = _key(self.hashes[uid], variants, self.seed)
            for begin in range(0, len(units), PLACES_AT_ONCE):
                part = slice(begin, begin + PLACES_AT_ONCE)
                count = self.places.width[uid[part]]
                place = _take(self.places.flat, self.places.first, self.places.width, uid[part])
                row = np.repeat(np.arange(begin, begin + len(count)), count)
                anew[row[~_kept(key[row], place, self.dropout)]] = True
            again = np.flatnonzero(anew)
            if len(again):
                more, wide = self._segment([units[i] for i in again.tolist()], variants[again], self.dropout)
                first[again], width[again] = self.ids.used + np.cumsum(wide) - wide, wide
                ids = np.concatenate([ids[: self.ids.used], more])
        doc = np.repeat(np.arange(len(texts)), [len(part) for part in split])
        return _take(ids, first, width, slice(None)), np.bincount(doc, weights=width, minlength=len(texts)).astype(np.int64)


class Rows:
    """Rows of numbers, one after another in ``flat``."""

    def __init__(self, kind: type):
        self.flat, self.used = np.zeros(1 << 16, kind), 0
        self.first, self.width = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, values: np.ndarray, widths: np.ndarray) -> None:
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(values)] = values
        self.first = np.concatenate([self.first, self.used + np.cumsum(widths, dtype=np.int64) - widths])
        self.width = np.concatenate([self.width, widths.astype(np.int32)])
        self.used += len(values)


def _take(flat: np.ndarray, first: np.ndarray, width: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
    """The values of ``rows`` in a row."""
    first, width = first[rows], width[rows].astype(np.int64)
    last = np.cumsum(width)
    return flat[np.repeat(first - last + width, width) + np.arange(last[-1] if len(last) else 0)]


@lru_cache(maxsize=2)
def shared_encoder(proto: bytes, seed: int, dropout: float, variants: int) -> Encoder:
    """One encoder for all tasks of a worker, so that its segmentations are used again."""
    return Encoder(load(proto), seed, dropout, variants)


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x for ids in lists for x in ids], np.int32), np.array([len(ids) for ids in lists], np.int64)


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    """The text of a row of ids: joined pieces and bytes, less the space in front. Control and unknown ids are empty."""
    text = b"".join(map(pieces.raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of stretches of some CHUNK_CHARS bytes together; null is the empty text, and no text is cut."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + CHUNK_CHARS)))
        yield begin, [t or "" for t in texts.slice(begin, end - begin).to_pylist()]
        begin = end


def _encoded(batches: Iterator[tuple[pa.Array, pa.Array]], encoder: Encoder) -> Iterator[tuple[pa.ListArray, np.ndarray, np.ndarray]]:
    for docs, texts in batches:
        for begin, part in _chunks(texts):
            names = [0 if d is None else d for d in docs.slice(begin, len(part)).to_pylist()]
            ids, widths = encoder.encode(names, part)
            offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), ids, offsets


def piece_ids(doc_id: Column, text: Column, proto: bytes, *, seed: int = 0, dropout: float = DROPOUT, variants: int = VARIANTS) -> Column:
    """Ids of a text. At each place of a document, a candidate merge of its unit (a word and the spaces before it) is skipped with
    the probability ``dropout``, by a hash of seed, document, place, unit and the candidate's place in it; ``dropout=0`` gives the plain encoding.
    ``variants`` bounds the number of segmentations of a unit.

    Null and empty texts have no ids; a null doc_id counts as 0. A literal U+2581 is spelt in bytes, so that it survives.
    """

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows, _, _ in _encoded(batches, shared_encoder(proto, seed, dropout, variants)):
            yield rows

    return encode(doc_id.cast("long"), text)


def coded(doc_id: Column, text: Column, proto: bytes, *, seed: int = 0, dropout: float = DROPOUT, variants: int = VARIANTS) -> Column:
    """Struct of the ids of a text, as piece_ids gives them, and ``decoded``, the text that these ids decode to."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = shared_encoder(proto, seed, dropout, variants)
        for rows, ids, offsets in _encoded(batches, encoder):
            cuts = offsets.tolist()
            texts = pa.array([decode_ids(encoder.pieces, ids[a:b].tolist()) for a, b in zip(cuts, cuts[1:])], pa.string())
            yield pa.StructArray.from_arrays([rows, texts], names=["ids", "decoded"])

    return both(doc_id.cast("long"), text)


def pieces_text(ids: Column, proto: bytes) -> Column:
    """The text of an array of ids; null and empty arrays give the empty text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = load(proto)
        for rows in batches:
            yield pa.array([decode_ids(pieces, row.values.to_numpy().tolist()) if row.is_valid else "" for row in rows], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, proto: bytes, **options) -> DataFrame:
    """``docs`` with ``ids`` and ``n_pieces``, which replace columns of those names; see piece_ids."""
    ids = piece_ids(F.col("doc_id"), F.col("text"), proto, **options)
    return docs.drop("ids", "n_pieces").withColumn("ids", ids).withColumn("n_pieces", F.size("ids").cast("long"))
